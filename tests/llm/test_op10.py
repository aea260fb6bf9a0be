import re

import numpy as np

from pulsespark.llm import op10_superminhash as o
from pulsespark.llm._components import components
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for e in {e for x in s for e in holders[x] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def same(spark, got, rows, percent):
    want = brute_force(rows, percent)
    have = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert have == want
    return want


def test_query_is_exact_here(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = same(spark, o.op10_superminhash(spark, SF), rows, 85)
    assert any(d != c for d, (_, c) in want.items())


def test_signatures_estimate_similarity():
    a = [np.unique(np.random.default_rng(i).integers(0, 1 << 52, 300).astype(np.uint64)) for i in range(40)]
    base = a[0]
    sets, true = [base], []
    for x in a[1:]:
        k = len(true) * 7
        mixed = np.unique(np.concatenate([base[k:], x[:k]]))
        sets.append(mixed)
        true.append(len(np.intersect1d(base, mixed)) / len(np.union1d(base, mixed)))
    sig = o.superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    guess = (sig[1:] == sig[0]).mean(axis=1)
    assert np.abs(guess - true).max() < 0.16 and np.abs(guess - true).mean() < 0.05


def test_chains_and_mixed_buckets(spark, frame, monkeypatch):
    monkeypatch.setattr(o, "BLOCK", 16)
    rows, base = [], words(200, 1)
    for d in range(60):  # each differs a little more from the first: links only between neighbours
        base = [*base]
        base[(d * 37) % 200] = f"n{d}"
        rows.append((d, " ".join(base)))
    rows += [(100 + d, " ".join(words(100, d))) for d in range(30)]
    rows += [(200 + d, " ".join(words(60, 7))) for d in range(50)]
    same(spark, o.near_duplicates(frame(rows).repartition(5)), rows, 85)


def test_edge_cases(spark, frame):
    rows = [(1, None), (2, ""), (3, "  \t "), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 50_000), (10, "x " * 9)]
    got = o.near_duplicates(frame(rows))
    same(spark, got, rows, 85)
    kept = {r["doc_id"] for r in o.drop_near_duplicates(frame(rows)).collect()}
    assert kept == {1, 2, 3, 4, 6, 7, 9}
    more = o.near_duplicates(frame([(None, "a b c d e"), (7, "a b c d e"), (7, "q w e r t"), (8, "q w e r t")])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in more} == {(None, None), (7, 7), (8, 7)}
    assert o.near_duplicates(frame([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)] + [(120, 300), (5, 5), (7, 8)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in [*range(100, 140), 300])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_do_not_settle_links(spark):
    """Equal sets whose signatures agree in one band only are still confirmed on the sets."""
    packed = np.arange(60, dtype=">u8").view(np.uint8).reshape(-1, 8)[:, 8 - o.SET_BYTES :].tobytes()
    sig = np.arange(2 * o.SLOTS, dtype="<u4").reshape(2, -1)
    sig[1, : o.ROWS] = sig[0, : o.ROWS]
    rows = [(9, 0, 2, 120, d, 60, d, sig[d - 1].tobytes(), packed) for d in (1, 2)]
    df = spark.createDataFrame(rows, "key long, band int, n long, total long, d long, size long, c long, sig binary, set binary")
    assert [tuple(r) for r in o.linked_within(df, 85).collect()] == [(1, 2)]


def test_repeated_rows_and_null_ids(spark, frame):
    text, other = " ".join(words(60, 1)), " ".join(words(60, 2))
    rows = [(5, text), (5, text), (3, text + " end"), (None, text), (None, other), (None, other), (7, other + " end"), (5, "one two"), (8, None), (8, None), (None, ""), (None, "")]
    got = o.drop_near_duplicates(frame(rows))
    assert "_row" not in got.columns and got.columns == frame(rows).columns
    want = [(3, text + " end"), (5, "one two"), (7, other + " end"), (8, None), (8, None), (None, ""), (None, "")]
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in got.collect()])) == sorted(map(str, want))
