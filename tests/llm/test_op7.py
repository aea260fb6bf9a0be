import re

import numpy as np
import pytest

from pulsespark.llm import op7_windows as o
from tests.llm.conftest import words


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def check(rows, got):
    text = {d: split(t) for d, t in rows}
    for r in got:
        a, b = text[r["doc_id"]][r["start"] : r["end"]], text[r["match_doc_id"]][r["match_start"] : r["match_end"]]
        x, y = shingles(a), shingles(b)
        assert len(a) >= 50 and len(b) >= 50 and r["match_doc_id"] < r["doc_id"]
        assert abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8


def test_compact_windows_are_tree_nodes():
    token = np.random.default_rng(0).integers(0, 40, 90).astype(np.uint64)
    cuts = np.array([0, 30, 30, 90])
    h = o.function_hashes(token, 3)
    want = []

    def tree(a, b):
        if b - a >= 8:
            c = min(range(a, b), key=lambda i: (int(h[i]), i % 64, i))
            tree(a, c)
            want.append((max(a, c - 7), c, min(c, b - 8)))
            tree(c + 1, b)

    tree(0, 30)
    tree(30, 90)
    assert list(zip(*(v.tolist() for v in o.compact_windows(token, cuts, 3, 8)), strict=True)) == want


def test_bands_are_all_windows_of_joined_intervals():
    token = np.random.default_rng(1).integers(0, 60, 120).astype(np.uint64)
    cuts = np.array([0, 50, 53, 120])
    text, place, key = o.bands(token, cuts, 2, 3, 10)
    want = set()
    for x, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        for s in range(a, b - 9):
            for band in range(2):
                tops = [min(range(s, s + 10), key=lambda i: (int(o.function_hashes(token, 40 + 3 * band + r)[i]), i % 64)) for r in range(3)]
                k = np.array([band + 1], np.uint64)
                for r, c in enumerate(tops):
                    k = o.mix(k ^ token[c : c + 1], 90 + r)
                want.add((x, tops[0] - a, int(k[0])))
    assert set(zip(text.tolist(), place.tolist(), key.tolist(), strict=True)) == want


def test_planted_passages(spark, frame):
    passages = [words(70, 100 + k) for k in range(6)]
    rows, planted = [], {}
    for d in range(60):
        own = words(120, d, 10**6)
        k = d % 10
        if k < 6:
            p = list(passages[k])
            if d >= 30:
                p[35] = f"edit{d}"
            planted[d] = k
            own = own[:50] + p + own[50:]
        rows.append((d, " ".join(own).upper() if d == 12 else " ".join(own)))
    got = o.near_passages(frame(rows)).collect()
    check(rows, got)
    group = {d: d for d in range(60)}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for r in got:
        group[root(r["doc_id"])] = root(r["match_doc_id"])
    for d, k in planted.items():
        assert root(d) == root(k), d
    assert {r["doc_id"] for r in got} | {r["match_doc_id"] for r in got} == set(planted)


def test_members_unlike_the_pivot_are_held_against_each_other(spark, frame):
    """A shared core of few words makes one group of windows; what surrounds it differs, but for documents 2 and 3."""
    core = words(60, 1)
    a, b, c, e = (words(60, 9 + k, 10**6) for k in range(4))
    rows = [(1, " ".join(a + core[:12] + b)), (2, " ".join(c + core[:12] + e)), (3, " ".join(c + core[:12] + e))]
    got = o.near_passages(frame(rows)).collect()
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(3, 2)}


def test_edge_cases(spark, frame):
    p = " ".join(words(60, 4))
    rows = [(1, None), (2, ""), (3, "few words"), (4, p), (5, p), (None, p), (5, p), (6, "a " * 500), (7, "a " * 300)]
    got = o.near_passages(frame(rows)).collect()
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(5, 4), (7, 6)}
    assert o.near_passages(frame([])).count() == 0


@pytest.mark.parametrize("n", [49, 50])
def test_shortest_passage(spark, frame, n):
    p = " ".join(words(n, 4))
    got = o.near_passages(frame([(1, p), (2, p)])).collect()
    assert [(r["start"], r["end"]) for r in got] == ([(0, 50)] if n == 50 else [])


def best(tx, ty):
    """The greatest similarity of stretches of WINDOW tokens and more, over all of them."""
    most = 0.0
    for a in range(len(tx) - o.WINDOW + 1):
        for b in range(a + o.WINDOW, len(tx) + 1):
            sx = set(tx[a:b].tolist())
            for c in range(len(ty) - o.WINDOW + 1):
                for d in range(c + o.WINDOW, len(ty) + 1):
                    sy = set(ty[c:d].tolist())
                    most = max(most, len(sx & sy) / len(sx | sy))
    return most


def test_one_sided_insertions_by_brute_force():
    import random

    r, seen = random.Random(3), set()
    for trial in range(40):
        w = words(r.randrange(52, 58), 500 + trial, 10**6)
        v = list(w)
        at = r.randrange(len(v))
        v[at:at] = words(r.randrange(1, 7), 900 + trial, 10**6)
        v = v[: len(w) + 3]
        pick = [o.tokens(np.frombuffer(" ".join(t).encode(), np.uint8), np.array([0, len(" ".join(t))]))[0] for t in (w, v)]
        for tx, ty in (pick, pick[::-1]):
            got = o.near_passages_of(tx, np.array([0, len(tx)]), ty, np.array([0, len(ty)]))[0]
            assert bool(len(got)) == (best(tx, ty) >= 0.8), trial
            seen.add(bool(len(got)))
    assert seen == {True, False}


def test_insertion_in_the_middle(spark, frame):
    w = words(84, 1, 10**6)
    rows = [(1, " ".join(w)), (2, " ".join(w[:42] + words(8, 2, 10**6) + w[42:]))]
    got = o.near_passages(frame(rows)).collect()
    check(rows, got)
    assert {(r["start"], r["end"], r["match_start"], r["match_end"]) for r in got} == {(0, 92, 0, 84)}


def test_versions_of_settled_places_are_linked(spark, frame):
    """y is near x, z is near y but not near x, and all keys of y and z are keys of x too."""
    x = words(50, 1, 10**6)
    y = x[:46] + words(4, 2, 10**6)
    z = words(4, 3, 10**6) + y[4:]
    rows = [(d, " ".join(t)) for d, t in ((1, x), (2, y), (3, z))]
    got = o.near_passages(frame(rows)).collect()
    check(rows, got)
    assert {(r["doc_id"], r["match_doc_id"]) for r in got} == {(2, 1), (3, 2)}


def test_slices_do_not_matter(spark, frame):
    """Document 2 has all keys of a passage that only 1 and 3 have whole, and lies in one slice with 3."""
    x = words(50, 133, 10**6)
    rows = [(1, " ".join(x)), (2, " ".join(x[:42] + words(30, 134, 10**6))), (3, " ".join(x))]
    for n in (1, 2, 3):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
        got = o.near_passages(df).collect()
        check(rows, got)
        assert (3, 1, 1.0) in {(r["doc_id"], r["match_doc_id"], r["similarity"]) for r in got}


def linked(spark, rows, monkeypatch):
    """What _linked_within's task finds in rows (key, d, begin, own, free, tokens), and how often it looks at sets of pairs."""
    import pyarrow as pa

    runs, calls = [], []
    around = [(r[5] << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for r in rows]
    table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("key", "d", "begin", "own", "free"))} | {"around": pa.array(around, pa.binary())})
    empty = spark.createDataFrame([], "key long, d long, place int, free boolean, begin int, own int, n int, around binary, blocks int")
    triu = np.triu_indices
    with monkeypatch.context() as m:
        m.setattr(type(empty.groupBy("key")), "applyInArrow", lambda self, f, schema: runs.append(f))
        m.setattr(np, "triu_indices", lambda *a: (calls.append(1), triu(*a))[1])
        o._linked_within(empty, 32)
        got = runs[0](table).to_pylist()
    return {tuple(r.values()) for r in got}, len(calls)


def test_keys_are_held_together(spark, monkeypatch):
    """Keys of one call give what each gives alone, and their pairs are looked at together; equal tokens of two keys do not meet."""
    rng = np.random.default_rng(5)
    rows = []
    for key in range(60):
        base = rng.integers(0, 1 << 40, 91, dtype=np.uint64)
        for k in range(3):
            near = base.copy()
            near[10 * k : 10 * k + 4] = rng.integers(0, 1 << 40, 4, dtype=np.uint64)
            rows.append((key, 10 * key + k, 0, 45, k > 0, near))
        if key % 3 == 0:
            rows += [(key, 10 * key + 5 + k, 0, 45, True, np.full(91, 7, np.uint64)) for k in range(2)]
    together, calls = linked(spark, rows, monkeypatch)
    apart = [linked(spark, [r for r in rows if r[0] == key], monkeypatch) for key in range(60)]
    assert together == set().union(*(x for x, _ in apart)) and len({x // 10 for x, *_ in together}) == 60
    assert all(x // 10 == y // 10 for x, y, *_ in together)
    assert calls < 20
