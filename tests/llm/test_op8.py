import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsespark.llm import op8_bitpack as b

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.data())
def test_pack_round_trip(width, ids, data):
    ids = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    block = b.pack(ids, width)
    assert len(block) == b.HEADER.size + -(-len(ids) * width // 8)
    assert b.unpack(block).tolist() == ids.tolist()
    start = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - start))
    assert b.unpack(block, start, count).tolist() == ids[start : start + count].tolist()


def plain(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(b.tokenizer_path())
    at = 0
    for d, text in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        yield d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in b.op8_bitpack(spark, SF).collect()) == list(plain(rows))


def test_odd_texts(spark, frame):
    texts = [None, "", " ", "\n\n", "tab\tand\x0bmore space　wide line", "é é ﬁ Ⅳ", "日本語 テキスト", "emoji 👩‍👩‍👧 x", "a" * 5000, "don't_stop-now...ok?!", "\x00\x01 control", "MiXeD CaSe", "12,345.67€ #tag @me", "word " * 30_000, "ß ẞ İ ı ſ K", "​zero‍width"]
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in b.read_ids(b.write_ids(frame(rows).repartition(5), block_ids=1000)).collect())
    assert got == list(plain(rows))


def test_repeats_nulls_and_empty(spark, frame):
    got = b.read_ids(b.write_ids(frame([(2, "b"), (None, "a"), (2, "b"), (1, "c")]))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2]
    assert b.read_ids(b.write_ids(frame([]))).count() == 0
