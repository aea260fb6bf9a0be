"""GIF columns: LZW streams, palettes, disposal and transparency, timed frames with colour histograms.

The LZW decoder is vectorised. The string of a code made at step p equals the output from where step p began, one
symbol longer than that step; so every output symbol has a place earlier in the output that it copies, and following
those places to literals by pointer doubling gives the whole output in a few gathers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, slices, stored

CLEAR_CODES = 3837  # codes between two clear codes of our encoder: the table is then full
WIDTH = 64
ROWS = 16384  # rows of a frame at most
#: Pixels of a canvas or an image at most; a header that asks for more is refused before anything is allocated.
MAX_PIXELS = 1 << 25
#: Bytes of canvases that frame_table gives out at once.
OUT_BYTES = 16 << 20


def _widths(minimum: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code."""
    free = (1 << minimum) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, minimum + 1, 12)


_WIDTHS = {m: _widths(m, 4096) for m in range(2, 9)}


def lzw_encode(samples: bytes) -> bytes:
    """LZW of 8-bit samples for GIF (minimum code size 8), without sub-blocks."""
    codes = [256]
    add = codes.append
    cuts = [0]
    table: dict[int, int] = {}
    get, free, limit = table.get, 258, 258 + CLEAR_CODES
    prefix = -1
    for x in samples:
        if prefix < 0:
            prefix = x
            continue
        key = prefix << 8 | x
        code = get(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        table[key] = free
        free += 1
        prefix = x
        if free == limit:
            cuts.append(len(codes))
            add(256)
            table.clear()
            free = 258
    if prefix >= 0:
        add(prefix)
    add(257)
    values = np.array(codes, np.int64)
    # a clear code closes the run before it, so runs begin after it
    heads = np.array(cuts, np.int64) + 1
    at = np.arange(len(values))
    run = np.searchsorted(heads, at, side="right") - 1
    bits = np.where(run >= 0, _WIDTHS[8][np.minimum(at - heads[np.maximum(run, 0)], 4095)], 9)
    ends = np.cumsum(bits)
    place = ends - bits
    shifted = values << (place & 7)
    byte = place >> 3
    total = int(-(-int(ends[-1]) // 8))
    out = np.zeros(total + 2)
    for k in range(3):
        out += np.bincount(byte + k, (shifted >> (8 * k)) & 255, minlength=total + 2)[: total + 2]
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, minimum: int, size: int) -> np.ndarray:
    """At most `size` samples of a GIF LZW stream. A stream that breaks off gives what came before."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    clear, end = 1 << minimum, (1 << minimum) + 1
    widths, n_bits = _WIDTHS[minimum], 8 * len(data)
    at, codes, parents, count = 0, [], [], 0
    done = False
    while not done and at < n_bits:
        run_codes = []
        first = True
        while True:  # the codes up to the next clear code
            w = widths if first else np.full(4096, 12)
            place = at + np.cumsum(w) - w
            ok = place + w <= n_bits
            place, w = place[ok], w[ok]
            byte = place >> 3
            got = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (place & 7)) & ((1 << w) - 1)
            stop = np.flatnonzero((got == clear) | (got == end))
            if len(stop):
                k = stop[0]
                run_codes.append(got[:k])
                at = int(place[k] + w[k])
                done = got[k] == end
                break
            run_codes.append(got)
            at = int(place[-1] + w[-1]) if len(place) else n_bits
            first = False
            if not len(got) or at >= n_bits:
                done = True
                break
        c = np.concatenate(run_codes)
        if len(c):
            p = np.where(c < clear, -1, c - clear - 2)
            bad = np.flatnonzero(p >= np.arange(len(c)))  # a code that is not made yet
            if len(bad):
                c, p, done = c[: bad[0]], p[: bad[0]], True
            codes.append(c)
            parents.append(np.where(p < 0, -1, p + count))
            count += len(c)
    if not count:
        return np.zeros(0, np.uint8)
    c, p = np.concatenate(codes), np.concatenate(parents)
    literal = p < 0
    up, step = np.where(literal, np.arange(count), p), np.where(literal, 0, 1)
    while True:  # a code is one symbol longer than each code above it
        step, further = step + step[up], up[up]
        if np.array_equal(further, up):
            break
        up = further
    length = 1 + step
    starts = np.cumsum(length) - length
    count = int(np.searchsorted(starts, size))  # symbols copy earlier ones only, so what is past size is not expanded
    c, p, literal, length, starts = (x[:count] for x in (c, p, literal, length, starts))
    if not count:
        return np.zeros(0, np.uint8)
    n = int(length.sum())
    owner = np.repeat(np.arange(count), length)
    position = np.arange(n)
    source = np.where(literal[owner], position, np.where(literal, 0, starts[np.maximum(p, 0)])[owner] + position - starts[owner])
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return c[owner[source]].astype(np.uint8)[:size]


def _blocks(data: bytes) -> bytes:
    n = len(data)
    return b"".join(bytes([min(255, n - i)]) + data[i : i + 255] for i in range(0, n, 255)) + b"\0"


_GREYS = bytes(x for i in range(256) for x in (i, i, i))


def encode(payload: bytes, width: int = WIDTH, delay: int = 10) -> bytes:
    """A GIF whose samples are the bytes of payload (a multiple of width), 16384 rows a frame at most, greys as palette."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, ROWS), 0xF7, 0, 0), _GREYS]
    for at in range(0, rows, ROWS):
        part = payload[at * width : (at + ROWS) * width]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """One image of a file: its samples (palette indexes), and the whole canvas after it, RGBA."""

    delay_ms: int
    disposal: int
    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray | None


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def frames(data: bytes, canvas: bool = True):
    """Frames of a GIF in order. canvas=False leaves the drawing out. ValueError if the data are no GIF, or ask for more
    than MAX_PIXELS. What draws beyond the canvas is cut; a stream that breaks off leaves index 0."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    table = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    if width * height > MAX_PIXELS:
        raise ValueError("canvas too large")
    screen = np.zeros((height, width, 4), np.uint8) if canvas else None
    delay, disposal, transparent = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal = struct.unpack_from("<H", body, 1)[0] * 10, body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            at = after
        elif data[at] == 0x2C and at + 10 < len(data):
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > MAX_PIXELS:
                raise ValueError("image too large")
            at += 10
            palette = table
            if local & 0x80:
                n = 2 << (local & 7)
                palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
                at += 3 * n
            minimum = data[at]
            body, at = _sub_blocks(data, at + 1)
            got = lzw_decode(body, min(max(minimum, 2), 8), w * h)
            samples = np.zeros(w * h, np.uint8)
            samples[: len(got)] = got
            samples = samples.reshape(h, w)
            if local & 0x40:  # rows in four passes
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            if screen is not None:
                before = screen.copy() if disposal == 3 else None
                full = np.zeros((256, 4), np.uint8)
                full[: len(palette), :3] = palette
                full[:, 3] = 255
                rows, cols = slice(top, min(top + h, height)), slice(left, min(left + w, width))
                part = samples[: max(0, height - top), : max(0, width - left)]
                if transparent is None:
                    screen[rows, cols] = full[part]
                else:
                    drawn = part != transparent
                    screen[rows, cols][drawn] = full[part[drawn]]
                yield Frame(delay, disposal, left, top, samples, palette, screen.copy())
                if disposal == 2:
                    screen[rows, cols] = 0
                elif before is not None:
                    screen = before
            else:
                yield Frame(delay, disposal, left, top, samples, palette, None)
            delay, disposal, transparent = 0, 0, None
        else:
            break


def histogram(values: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of 8-bit values in equal bins."""
    return np.bincount(values.reshape(-1) >> (8 - bins.bit_length() + 1), minlength=bins).tolist()


def colours(frame: Frame, bins: int = 16) -> list[list[int]]:
    """Histograms of red, green and blue over what is not transparent on the canvas after a frame."""
    flat = frame.canvas.reshape(-1, 4)
    seen = flat if (flat[:, 3] > 0).all() else flat[flat[:, 3] > 0]
    return [histogram(seen[:, c], bins) for c in range(3)]


def frame_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per frame: key, frame, at_ms (its time), delay_ms, width, height, rgba, and red, green, blue histograms
    (16 bins over what is not transparent). A null file, and one that breaks (no GIF, more than MAX_PIXELS), has a row
    with frame -1 and nulls, after the frames before the break. Repeated rows and null keys each have their own frames.
    Frames are given out every OUT_BYTES of canvases, so a file of many frames does not fill a task."""

    def run(batches):
        names = [key, *"frame at_ms delay_ms width height rgba red green blue".split()]

        def table(out, kind):
            kinds = [kind, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch, column):
                kind = part.schema.field(key).type
                out: list[tuple] = []
                held = 0
                for k, data in zip(part.column(key).to_pylist(), part.column(column).to_pylist(), strict=True):
                    try:
                        at = 0
                        for i, f in enumerate(frames(data or b"")):
                            out.append((k, i, at, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), *colours(f)))
                            at += f.delay_ms
                            held += f.canvas.size
                            if held > OUT_BYTES:
                                yield table(out, kind)
                                out, held = [], 0
                    except (ValueError, IndexError, struct.error):
                        out.append((k, -1, *[None] * 8))
                if out:
                    yield table(out, kind)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, frame int, at_ms long, delay_ms int, width int, height int, rgba binary, red array<bigint>, green array<bigint>, blue array<bigint>")


def to_gif(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text (null: empty) as UTF-8, filled with bytes 0 to a positive multiple of 64, as GIF.
    Repeated rows and null ids each have their own row, an empty table has none; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("t").to_pylist()]
                media = [encode(t + b"\0" * (-len(t) % WIDTH if t else WIDTH)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def payload_digest(media: DataFrame) -> DataFrame:
    """Digests of what the stored GIFs hold, decoded from their bytes: the samples are the payload, and the feature is the
    number of frames and the red, green and blue histograms of the drawn canvases, summed over frames. One row a row."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media"):
                out = []
                for d, n, data in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    samples, colour = [], np.zeros((3, 16), np.int64)
                    for f in frames(data):
                        samples.append(f.samples.tobytes())
                        colour += np.array(colours(f))
                    payload = b"".join(samples)
                    feature = f"{len(samples)}:" + ";".join(",".join(map(str, c)) for c in colour.tolist())
                    out.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document stored as GIF frames and read back; see to_gif and payload_digest. A null text is an empty one (64
    bytes of padding), equal texts give equal values whatever their ids, an empty table gives none."""
    return payload_digest(stored(to_gif(documents(spark, sf_dir)), "gif"))
