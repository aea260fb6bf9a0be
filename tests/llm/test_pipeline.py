import numpy as np

import corpus_pipeline as p
from pulsespark.llm._common import documents
from tests.llm.test_op10 import brute_force
from tests.llm.test_op8 import plain

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark, tmp_path):
    docs = documents(spark, SF)
    columns = docs.columns
    before = {}
    for name, stage in p.STAGES:
        rows = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "token_ids":
            given = [(r["doc_id"], r["text"]) for r in docs.collect()]
            want = sorted((d, n, c) for d, _, n, c in plain(given))
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()) == want
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept = [r["doc_id"] for r in docs.collect()]
        gone = set(rows) - set(kept)
        if name == "language":
            assert all(r["lang"] for r in docs.collect()) and not any(any(map(str.isalpha, rows[d]["text"] or "")) and len(rows[d]["text"]) > 200 for d in gone)
        elif name == "near_duplicates":
            parts = brute_force([(d, r["text"]) for d, r in rows.items()], 80)
            assert sorted(kept) == sorted(d for d, (_, c) in parts.items() if c == d)
        elif name == "decontamination":
            items = [r["text"] for r in documents(spark, SF, "benchmark").collect()]
            holding = {d for d, r in rows.items() if any(t in (r["text"] or "") for t in items)}
            assert holding <= gone and len(gone) < 0.3 * len(rows)
        elif name == "mixture":
            assert max(np.unique(kept, return_counts=True)[1]) <= 3
        before = rows
    assert before


def test_run(spark):
    got = p.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50


def test_stages_hold_little_text_at_a_time(spark, monkeypatch):
    """What workers of language, signatures and decontamination allocate for 4 MB of text that come in one Arrow batch."""
    import tracemalloc

    import pyarrow as pa

    from pulsespark.llm import op3_language, op9_bm25, op10_superminhash

    docs = spark.createDataFrame([(i, f"some words of document {i} " * 9, "en") for i in range(40)], "doc_id long, text string, lang string")
    model, runs = op3_language.train(docs), []
    items = spark.createDataFrame([(1, "is this an item? it has an answer.")], "item_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (runs.append(f), self)[1])
    op3_language.detect(docs, model)
    op9_bm25.decontaminate(docs, items)
    op10_superminhash.packed_sets(docs.selectExpr("doc_id as d", "text as t"))
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(1300)]
    batch = pa.record_batch({"d": pa.array(range(1300)), "text": texts, "t": texts})
    assert len(runs) == 3 and batch.column("t").nbytes > 4_000_000
    for run in runs:
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 50_000_000, peak
