import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsespark.llm import op6_gif as g

SF = "/root/testdata/sf0.001"


def plain_lzw(data, minimum, size):
    clear, end = 1 << minimum, (1 << minimum) + 1
    bits, out, width, at = int.from_bytes(data, "little"), [], minimum + 1, 0
    table, prev = {i: [i] for i in range(clear)}, None
    free = end + 1
    while at + width <= 8 * len(data):
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, free, width, prev = {i: [i] for i in range(clear)}, end + 1, minimum + 1, None
            continue
        if code == end:
            break
        if prev is None:
            word = table[code]
        else:
            word = table[code] if code in table else table[prev] + table[prev][:1]
            if free < 4096:
                table[free] = table[prev] + word[:1]
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
        out += word
        prev = code
    return out[:size]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300) | st.lists(st.integers(0, 2), max_size=3000).map(bytes))
def test_round_trip(data):
    coded = g.lzw_encode(data)
    assert g.lzw_decode(coded, 8, len(data)).tobytes() == data
    assert bytes(plain_lzw(coded, 8, len(data))) == data


def test_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 40_000).astype(np.uint8).tobytes()
    coded = g.lzw_encode(data)
    assert g.lzw_decode(coded, 8, len(data)).tobytes() == data == bytes(plain_lzw(coded, 8, len(data)))


def gif(images, width=4, height=4):
    """images: (left, top, rows, disposal, transparent, delay)"""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette
    for left, top, rows, disposal, transparent, delay in images:
        flags = disposal << 2 | (transparent is not None)
        out += b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay, transparent or 0) + b"\0"
        a = np.array(rows, np.uint8)
        codes = [4] + [c for x in a.reshape(-1).tolist() for c in (x, 4)] + [5]  # a clear code after each sample
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        data = bits.to_bytes(-(-3 * len(codes) // 8), "little")
        out += b"\x2c" + struct.pack("<HHHHB", left, top, a.shape[1], a.shape[0], 0) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_disposal_and_transparency():
    full, part = [[1] * 4] * 4, [[2, 0], [0, 2]]
    f = list(g.frames(gif([(0, 0, full, 1, None, 5), (1, 1, part, 2, 0, 7), (0, 0, [[3]], 3, None, 0), (3, 3, [[2]], 0, None, 1)])))
    assert [x.delay_ms for x in f] == [50, 70, 0, 10]
    rgb = lambda x, r, c: tuple(f[x].canvas[r, c])
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert rgb(0, 1, 1) == red and rgb(1, 1, 1) == green and rgb(1, 1, 2) == red
    assert rgb(2, 1, 1) == (0, 0, 0, 0) and rgb(2, 0, 0) == blue  # the second frame's place was cleared
    assert rgb(3, 0, 0) == red and rgb(3, 3, 3) == green  # the third was undone


def test_frame_table(spark):
    rows = [(1, bytearray(gif([(0, 0, [[1] * 4] * 4, 1, None, 5), (0, 0, [[2] * 4] * 4, 1, None, 5)]))), (2, None), (3, bytearray(b"junk")), (4, bytearray(b"GIF89a"))]
    got = g.frame_table(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id").collect()
    first = [r for r in got if r["doc_id"] == 1]
    assert [(r["frame"], r["at_ms"]) for r in first] == [(0, 0), (1, 50)] and first[0]["red"][15] == 16 and first[1]["green"][15] == 16
    assert {r["doc_id"]: r["frame"] for r in got if r["doc_id"] > 1} == {2: -1, 3: -1, 4: -1}


def test_query(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in g.op6_gif(spark, SF).collect():
        t = docs.pop(r["doc_id"])
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert not docs


@pytest.mark.parametrize("text", [None, "", "x", "é" * 32, "y" * 64, "long " * 300_000])
def test_texts(spark, frame, text):
    t = (text or "").encode()
    r = g.payload_digest(g.to_gif(frame([(1, text)]))).first()
    p = t + b"\0" * (-len(t) % 64 if t else 64)
    assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["payload_bytes"] == len(p)


def test_empty(spark, frame):
    assert g.payload_digest(g.to_gif(frame([]))).count() == 0


def test_hostile_sizes(spark):
    import time

    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b";"
    image = gif([(0, 0, [[1]], 1, None, 5)])[:-1] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x01\x00\x00;"
    got = g.frame_table(spark.createDataFrame([(1, bomb), (2, image), (2, image)], "doc_id long, media binary"), "doc_id").collect()
    assert sorted((r["doc_id"], r["frame"]) for r in got) == [(1, -1), (2, -1), (2, -1), (2, 0), (2, 0)]
    began = time.time()
    coded = g.lzw_encode(b"a" * 6_000_000)  # a small stream that would expand to 6 MB
    assert g.lzw_decode(coded, 8, 100).tobytes() == b"a" * 100 and g.lzw_decode(coded, 8, 0).tobytes() == b""
    assert time.time() - began < 20


def test_feature_is_of_drawn_colours(spark, frame):
    text = "ab" * 40 + "\x00" + "é"
    t = text.encode()
    p = t + b"\0" * (-len(t) % 64)
    counts = ",".join(str(sum(x >> 4 == k for x in p)) for k in range(16))
    assert g.payload_digest(g.to_gif(frame([(1, text)]))).first()["feature"] == f"1:{counts};{counts};{counts}"
