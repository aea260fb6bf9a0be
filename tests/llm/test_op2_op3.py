import zlib

import numpy as np
import pytest

from pulsespark.llm import op2_quality as q
from pulsespark.llm import op3_language as lang
from pulsespark.llm._common import documents

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in q.op2_quality(spark, SF).collect()}
    assert len(got) == documents(spark, SF).count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    labels = [(r["doc_id"], r["quality"]) for r in documents(spark, SF, "labels").collect() if got[r["doc_id"]]["held_out"]]
    right = [got[d]["predicted"] == y for d, y in labels]
    assert len(right) > 50 and np.mean(right) > 0.85


def test_ranking_orders_what_it_learned(spark, frame):
    rows = [(i, "Good words, in a calm sentence. " * (3 + i % 5)) for i in range(40)] + [(100 + i, "BUY!!! $$$ click || now " * (3 + i % 5)) for i in range(40)]
    rows += [(500, None), (501, ""), (None, "x"), (1, rows[1][1])]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(3, 0), (700, 1)], "doc_id long, quality int")
    ranking = q.learn(frame(rows), labels)
    got = q.rate(frame(rows), ranking)
    assert got.count() == len(rows)
    s = {r["doc_id"]: r["score"] for r in got.collect()}
    assert min(s[i] for i in range(40)) > max(s[100 + i] for i in range(40))
    top = q.keep_above_quantile(got, 0.5)
    assert 0 < top.count() < len(rows)


def test_nothing_to_learn(spark, frame):
    docs = frame([(1, "text")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learn(docs, none) is None and q.rate(docs, None).first()["score"] == 0.5
    assert lang.train(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None
    r = lang.detect(docs, None).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert q.rate(frame([]), None).count() == 0 and lang.detect(frame([]), None).count() == 0


def test_languages_held_out(spark):
    got = {r["doc_id"]: r for r in lang.op3_language(spark, SF).collect()}
    right = []
    for r in documents(spark, SF).collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert g["lang_pred"] == "und" and g["score"] == 0
        elif g["held_out"] and r["lang"]:
            right.append(g["lang_pred"] == r["lang"])
    assert len(right) > 100 and np.mean(right) > 0.97


@pytest.mark.parametrize("text", ["hello the world", "äöü ß", "x", "a😀b\n" * 50])
def test_scores_are_those_of_plain_naive_bayes(text):
    model = lang.Model(["a", "b"], np.log([0.25, 0.75]), np.vstack([np.log(np.random.default_rng(1).dirichlet(np.ones(2048), 2).T).astype(np.float32), np.zeros((1, 2), np.float32)]))
    best, p = lang.score_texts(model, [text, "other"])
    total = model.prior.copy()
    for h, _ in lang.ngram_buckets([text], 2048):
        total += model.table[h].sum(axis=0, dtype=float)
    want = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
    assert best[0] == want.argmax() and abs(p[0] - want.max()) < 1e-6
