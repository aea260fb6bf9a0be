"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a code point. An agenda holds the adjacent pairs that make a piece, best score first and, of
equal scores, leftmost first; the top pair is merged and its new neighbours enter, until the agenda is empty. Symbols
that are no piece become byte pieces.

A text is cut only between code points that stand side by side in no piece of the vocabulary: no merge crosses such a
place, so the pieces of a text are those of its cut parts in order. Each different part goes through the agenda once and
is then held against the sentencepiece library in the Arrow batch that brings it; a difference is an error. A worker
remembers parts in tables of bounded size; long texts are taken stretch by stretch, so memory is bounded by a stretch
and the longest part.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, ragged, schema_with, slices
from pulsespark.llm.op8_bitpack import tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts of texts that a worker remembers.
CACHE_PARTS = 800_000
#: Parts of up to so many code points find the best pair by a scan.
SCAN = 64
NEVER = float("inf")
#: Code points of a stretch; it grows to the next place where a text may be cut.
STRETCH = 1 << 19
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
MARKS = r"!-/:-@\[-`{-~"


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message; values are ints or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, raw[at : at + size]
        at += size


class PieceCodec:
    """Encoder and decoder of one vocabulary file. Needs a merge-type vocabulary with byte pieces and plain
    normalization (blanks become U+2581, one is put before a text that is not empty); others raise ValueError."""

    def __init__(self, path: str, cache: int = CACHE_PARTS):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = cache
        proto = list(_fields(lib.serialized_model_proto()))
        trainer = dict(_fields(next((v for n, v in proto if n == 2), b"")))
        plain = dict(_fields(next((v for n, v in proto if n == 3), b"")))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only merge-type vocabularies with byte pieces are known")
        if plain.get(2) or not plain.get(3, 1) or plain.get(4, 1) or not plain.get(5, 1):
            raise ValueError("only vocabularies with plain normalization are known")
        self.size = n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        silent = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)) or self._user_defined(proto):
            raise ValueError("vocabularies with unused or user-defined pieces are not known")
        self.ids = {names[i]: i for i in range(n) if not byte[i] and not silent[i]}
        if SPACE not in self.ids:
            raise ValueError("a vocabulary without U+2581 is not known")
        self.rank = {w: -lib.get_score(i) for w, i in self.ids.items()}
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(byte):
            self.byte_id[int(names[i][1:-1], 16)] = i
        # what each id stands for in a decoded text, and its number in decimal with a comma
        surfaces = [bytes([int(w[1:-1], 16)]) if b else lib.decode([i]).encode() if s else w.replace(SPACE, " ").encode() for i, (w, b, s) in enumerate(zip(names, byte, silent, strict=True))]
        self.is_byte = np.array(byte)
        self.surface, self.surface_at = self._table(surfaces)
        self.decimal, self.decimal_at = self._table([b"%d," % i for i in range(n)])
        beside = {(a, b) for w in self.ids for a, b in zip(w, w[1:], strict=False)}
        self.cuts_blank = not any(b == SPACE != a for a, b in beside)
        self.cuts_line = not any("\n" in p for p in beside)
        self.cuts_marks = self.cuts_line and not any(re.match(f"[{LETTERS}]", a) and re.match(f"[{MARKS}]", b) for a, b in beside)
        blank = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.cuts_line else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.part = re.compile(blank if self.cuts_blank else r"[^\n]+|\n" if self.cuts_line else r"(?s).+")
        self.word = re.compile(f"({SPACE}?[{LETTERS}]+)([{MARKS}]+)").fullmatch
        self._forget()

    @staticmethod
    def _user_defined(proto) -> bool:
        return any(dict(_fields(v)).get(3, 1) == 4 for n, v in proto if n == 1)

    @staticmethod
    def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def agenda(self, part: str) -> list[int]:
        """Ids of one part (blanks already U+2581). Short parts keep their pairs' scores in a list by place, whose first
        minimum is the top of the agenda; long ones keep a heap."""
        symbols = self._scan(part) if len(part) <= SCAN else self._heap(part)
        out: list[int] = []
        for s in symbols:
            i = self.ids.get(s)
            out += [i] if i is not None else self.byte_id[np.frombuffer(s.encode(), np.uint8)].tolist()
        return out

    def _scan(self, part: str) -> list[str]:
        rank, symbols = self.rank.get, list(part)
        ranks = [rank(part[i : i + 2], NEVER) for i in range(len(part) - 1)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            merged = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [merged]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(merged + symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + merged, NEVER)
        return symbols

    def _heap(self, part: str) -> list[str]:
        rank, symbols, n = self.rank, list(part), len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := rank.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of them has been merged since
            symbols[left], symbols[right] = a + b, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (r := rank.get(a + b + symbols[nxt])) is not None:
                    heapq.heappush(heap, (r, left, nxt, size + len(symbols[nxt])))
            if (prev := before[left]) >= 0 and (r := rank.get(symbols[prev] + a + b)) is not None:
                heapq.heappush(heap, (r, prev, left, size + len(symbols[prev])))
        return [s for s in symbols if s]

    def verify(self, parts: list[str], ids: list[list[int]]) -> None:
        """Raises where the library encodes a part otherwise. Parts stand behind a cut: a line feed, where pieces don't
        cross it, or else the start of a text."""
        lead = "\n" if self.cuts_line else ""
        skip = len(self.library.encode(lead))
        given = [lead + p if lead else p.removeprefix(SPACE) for p in parts]
        for part, own, theirs in zip(parts, ids, self.library.encode(given, num_threads=1), strict=True):
            if own != theirs[skip:]:
                raise ValueError(f"part {part[:80]!r} has ids {own[:20]}, the library gives {theirs[skip:][:20]}")

    def _remember(self, new: list[str], flat: list[int], per: list[int]) -> None:
        at, n = len(self.known), len(new)
        while at + n > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts] * 2), np.concatenate([self.counts] * 2)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.counts[at : at + n] = per
        self.starts[at : at + n] = self.used + np.cumsum(per, dtype=np.int64) - per
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(new, range(at, at + n), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Parts not known yet. A word and the marks behind it are learnt apart, as few words have many kinds of them."""
        split = {p: (m[1], m[2]) for p in new if (m := self.word(p))} if self.cuts_marks else {}
        plain = [p for p in dict.fromkeys([*new, *(x for both in split.values() for x in both)]) if p not in split and p not in self.known]
        if plain:
            ids = [self.agenda(p) for p in plain]
            self.verify(plain, ids)
            self._remember(plain, [i for x in ids for i in x], [len(x) for x in ids])
        if split:
            rows = np.array([self.known[x] for both in split.values() for x in both])
            counts = self.counts[rows]
            self._remember(list(split), self.flat[ragged(self.starts[rows], counts)], counts.reshape(-1, 2).sum(1))

    def _rows(self, parts: list[str]) -> np.ndarray:
        """The remembered row of each part; new ones are learnt."""
        get = self.known.get
        at = np.array([get(p, -1) for p in parts], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(parts[i] for i in missing)))
            at[missing] = [get(parts[i]) for i in missing]
        return at

    def stretches(self, text: str):
        """A text with its first blank, in stretches of about STRETCH code points that end at cuts."""
        text = SPACE + text.replace(" ", SPACE)
        start = 0
        while start < len(text):
            end = start + STRETCH
            if end < len(text):
                end = next((m.start() + 1 for m in re.compile(f"[^{SPACE}](?={SPACE})").finditer(text, end)), len(text)) if self.cuts_blank else len(text)
            yield text[start:end]
            start = end

    def encode_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, ids of each) of texts that stretches() gave."""
        if len(self.known) > self.cache:
            self._forget()
        parts, per = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            found = self.part.findall(t)
            per[k] = len(found)
            parts += found
        rows = self._rows(parts)
        counts = self.counts[rows]
        ids = self.flat[ragged(self.starts[rows], counts)]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.cumsum(per)]
        return ids, np.diff(ends, prepend=0)

    def encode(self, text: str | None) -> list[int]:
        """All ids of one text; null is empty, and an empty text has none."""
        return [i for s in (self.stretches(text) if text else ()) for i in self.encode_stretches([s])[0].tolist()]

    def surfaces(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that the ids stand for, one after another."""
        return self.surface[ragged(self.surface_at[ids], self.surface_at[ids + 1] - self.surface_at[ids])]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids: the first blank goes, control pieces are silent, byte pieces that make no UTF-8 become U+FFFD a
        byte."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8), prepend=0, append=0))
        out, at = [], 0
        for lo, hi in edges.reshape(-1, 2):
            out.append(self.surfaces(ids[at:lo]).tobytes().decode())
            out.append(_lenient(self.surfaces(ids[lo:hi]).tobytes()))
            at = hi
        out.append(self.surfaces(ids[at:]).tobytes().decode())
        spoken = np.flatnonzero(self.surface_at[ids + 1] > self.surface_at[ids])
        text = "".join(out)
        first = len(spoken) and not self.is_byte[ids[spoken[0]]] and self.surface[self.surface_at[ids[spoken[0]]]] == 32
        return text[1:] if first and not self.library.is_unknown(int(ids[spoken[0]])) else text


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no whole code point."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


@functools.cache
def codec_for(path: str) -> PieceCodec:
    """One codec a worker."""
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str | None = None, text: str = "text", ids_out: str = "ids") -> DataFrame:
    """docs with an array column of ids. Null and empty texts have an empty array; repeated rows and columns of any other
    name stay. An array holds a whole text, so texts above some 100 MB should go through `digest_pieces`."""
    model = model or tokenizer_path(MODEL)

    def encode(batches):
        codec = codec_for(model)
        for batch in batches:
            for part in slices(batch, text):
                ids = pa.array([codec.encode(t) for t in part.column(text).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_out])

    return docs.mapInArrow(encode, schema_with(docs, **{ids_out: "array<int>"}))


def decode_pieces(docs: DataFrame, model: str | None = None, ids: str = "ids", text_out: str = "text") -> DataFrame:
    """docs with the text of an array of ids. Null arrays give null, empty ones an empty text; ids outside the vocabulary
    raise."""
    model = model or tokenizer_path(MODEL)

    def decode(batches):
        codec = codec_for(model)
        for batch in batches:
            out = pa.array([None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text_out])

    return docs.mapInArrow(decode, schema_with(docs, **{text_out: "string"}))


def library_differences(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, where) of every row whose ids or decoded text differ from the library's on the whole text. As slow as
    the library; meant for tests and for a new vocabulary."""
    model = model or tokenizer_path(MODEL)

    def compare(batches):
        codec = codec_for(model)
        for batch in batches:
            bad: list[tuple] = []
            for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
                own, theirs = codec.encode(t), codec.library.encode(t or "")
                if own != theirs:
                    bad.append((d, "ids"))
                elif codec.decode(own) != codec.library.decode(theirs):
                    bad.append((d, "text"))
            if bad:
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in bad], pa.int64()), pa.array([b[1] for b in bad])], names=["doc_id", "where"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(compare, "doc_id long, where string")


class _Digest:
    """Count and hashes of one text, fed stretch by stretch."""

    def __init__(self):
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, decimals: memoryview, n: int, surface: memoryview) -> None:
        """Ids in decimal with a comma behind each; surfaces, of which the very first blank is not text."""
        self.ids.update(b"," if self.n else b"")
        self.ids.update(decimals[:-1])
        self.text.update(surface if self.n else surface[1:])
        self.n += n


def _digest_texts(codec: PieceCodec, texts: list[str | None]) -> list[_Digest]:
    done = [_Digest() for _ in texts]
    held: list[tuple[int, str]] = []

    def flush():
        ids, per = codec.encode_stretches([s for _, s in held])
        ends = np.concatenate([[0], np.cumsum(per)])
        views = []
        for table, at in ((codec.decimal, codec.decimal_at), (codec.surface, codec.surface_at)):
            width = at[ids + 1] - at[ids]
            views.append((memoryview(table[ragged(at[ids], width)]), np.concatenate([[0], np.cumsum(width)])[ends].tolist()))
        (decimals, d), (surface, s) = views
        for k, (owner, _) in enumerate(held):
            done[owner].feed(decimals[d[k] : d[k + 1]], int(per[k]), surface[s[k] : s[k + 1]])
        held.clear()

    size = 0
    for owner, text in enumerate(texts):
        for stretch in codec.stretches(text) if text else ():
            held.append((owner, stretch))
            size += len(stretch)
            if size >= STRETCH:
                flush()
                size = 0
    if held:
        flush()
    return done


def digest_pieces(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row.

    n_tokens counts all ids; ids_sha256 is of the decimal ids joined by commas; decoded_sha256 of the text that the ids
    decode to. A null text counts as empty: 0 ids and hashes of nothing. Null ids and repeated rows stay as they are;
    further columns, whatever their names, are not read; an empty table gives an empty one. Rows are independent, so
    there is no shuffle, and no source or group of copies meets in a task. A text of any length passes in stretches.
    """
    model = model or tokenizer_path(MODEL)

    def digest(batches):
        codec = codec_for(model)
        for batch in batches:
            for part in slices(batch, "t"):
                done = _digest_texts(codec, part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array([x.n for x in done], pa.int64()), pa.array([x.ids.hexdigest() for x in done]), pa.array([x.text.hexdigest() for x in done])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`digest_pieces` of all documents with the 32k vocabulary."""
    return digest_pieces(documents(spark, sf_dir))
