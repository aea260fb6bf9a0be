import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsespark.llm import op12_pieces as op
from pulsespark.llm.op8_bitpack import tokenizer_path

PATH = tokenizer_path(op.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = op.PieceCodec(PATH)
ODD = ["", " ", "  ", "\n", " \n ", "a", "\n\na  b", "▁", "a▁b ▁▁c", "<s> </s> <unk> <0x0A>", "été œuvre—«déjà»", "日本語のテキスト", "🙂🙂 é", "\x00\x01 \t\r\n", "a.b,c!!", "x" * 3000, "ab" * 999, " " * 4000, "don't…stop", "Ünï-cödé 123,456.78", "� x", "É!É?"]


def plain_merge(text):
    """All pairs are looked at again for every merge: best score, then leftmost."""
    symbols = list("▁" + text.replace(" ", "▁")) if text else []
    while True:
        found = [(-LIBRARY.get_score(LIBRARY.piece_to_id(a + b)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in CODEC.ids]
        if not found:
            break
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return [i for s in symbols for i in ([CODEC.ids[s]] if s in CODEC.ids else [int(CODEC.byte_id[b]) for b in s.encode()])]


def test_odd_texts_as_the_library_and_as_plain_merging():
    for text in ODD:
        ids = CODEC.encode(text)
        assert ids == LIBRARY.encode(text)
        assert CODEC.decode(ids) == LIBRARY.decode(ids)
        if len(text) < 200:
            assert ids == plain_merge(text)
    assert CODEC.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁aeionst.,!é0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 270), st.integers(0, 31999)), max_size=12))
def test_any_ids_decode_as_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_small_tables_of_remembered_parts_and_short_stretches(monkeypatch):
    monkeypatch.setattr(op, "STRETCH", 7)
    codec = op.PieceCodec(PATH, cache=3)
    text = "The  quick brown\nfox, jumps... over\n\n the lazy dog! " * 20
    assert codec.encode(text) == LIBRARY.encode(text)
    found = op._digest_texts(codec, [text, None, "", "x"])
    ids = LIBRARY.encode(text)
    assert [x.n for x in found] == [len(ids), 0, 0, len(LIBRARY.encode("x"))]
    assert found[0].ids.hexdigest() == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert found[0].text.hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_a_difference_to_the_library_is_an_error():
    with pytest.raises(ValueError, match="the library gives"):
        CODEC.verify(["▁the"], [[5]])


def test_rows_with_nulls_repeats_and_clashing_columns(spark, frame):
    rows = [(1, "Hello, world"), (1, "Hello, world"), (None, "x y"), (2, None), (3, ""), (4, "lang " * 30000)]
    got = op.digest_pieces(frame(rows)).collect()
    assert got[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted((d if d is not None else -1, len(LIBRARY.encode(t or "")), hashlib.sha256(",".join(map(str, LIBRARY.encode(t or ""))).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(LIBRARY.encode(t or "")).encode()).hexdigest()) for d, t in rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want
    assert op.digest_pieces(frame([])).collect() == []


def test_ids_and_texts_in_tables(spark, frame):
    docs = frame([(1, "Hello, world"), (2, None), (3, "日本 \n x")])
    ids = op.encode_pieces(docs, ids_out="ids")
    back = op.decode_pieces(ids.select("doc_id", "ids", "n"), text_out="back").orderBy("doc_id").collect()
    assert [r["back"] for r in back] == ["Hello, world", "", "日本 \n x"]
    assert [list(r["ids"]) for r in back] == [LIBRARY.encode(t) for t in ("Hello, world", "", "日本 \n x")]


def test_all_documents_as_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert op.library_differences(docs).count() == 0
    got = {r[0]: r[1:] for r in op.op12_pieces(spark, "/root/testdata/sf0.01").collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest())


def test_other_vocabularies_are_refused(tmp_path):
    raw = open(PATH, "rb").read()
    changed = raw.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01")
    assert changed != raw
    (tmp_path / "other.model").write_bytes(changed)
    with pytest.raises((ValueError, RuntimeError, OSError)):
        op.PieceCodec(str(tmp_path / "other.model"))


def test_ids_are_plain_integers():
    assert all(isinstance(i, int) for i in CODEC.encode("a b"))
    assert isinstance(CODEC.decode(np.array([1, 2, 3])), str)
