import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsespark.llm import op13_variants as op


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_vocabulary(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(vocabulary):
    out, forms = {}, {}
    for w, n in vocabulary.items():
        near = sorted((-vocabulary[x], x) for x in vocabulary if distance_one(w, x))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        forms[w] = form
        out[w] = (form, n, len(near), vocabulary[form] if form else None)
    for w in out:
        at = w
        while forms[at]:
            at = forms[at]
        form, n, near, form_n = out[w]
        out[w] = (form, at, n, near, form_n)
    return out


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def small_words(seed, n, letters="ab", sizes=(4, 9)):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(*sizes))) for _ in range(n)})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=4, max_size=7), max_size=25), st.sets(st.text(alphabet="abéz", min_size=4, max_size=7), max_size=25))
def test_both_directions_find_each_near_word_once(words, asked):
    words, asked = sorted(words), sorted(asked)
    for q in asked:
        total = 0
        for backward in (False, True):
            for agree in range(8):
                half = (lambda x: len(x) // 2) if backward else (lambda x: (len(x) - 1) // 2)
                near, n, best = op.answer(words, np.arange(len(words)), [q], np.array([agree]), backward)
                total += int(near[0])
                assert near[0] <= sum(distance_one(q, x) and half(x) == agree for x in words)
        assert total == sum(distance_one(q, x) for x in words)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abcd", min_size=0, max_size=7), min_size=1, max_size=40))
def test_automaton_is_minimal_and_numbers_its_words(words):
    words = sorted(words)
    points, sizes = op._codes(words)
    alphabet, codes = np.unique(points, return_inverse=True)
    a = op.Automaton(codes, sizes, len(alphabet))
    assert a.size == len(words)
    for k, w in enumerate(words):
        state, number = np.array([a.root]), np.array([0])
        for c in w:
            state, number = a.step(state, number, np.searchsorted(alphabet, [ord(c)]))
        assert a.final[state[0]] and number[0] == k
    rights = {w[i:]: None for w in words for i in range(len(w) + 1)}
    suffixes = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(a.final) == len(suffixes) and rights


@pytest.mark.parametrize("each", [3, 50, 10**6])
def test_as_by_brute_force(spark, each):
    r = random.Random(each)
    words = {w: r.randrange(3, 60) for w in [*small_words(1, 300), *small_words(2, 60, "abcdefgh"), "a" * 3000, "a" * 3001, "a" * 2999 + "b"] if len(w) >= 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long").selectExpr("*", "1 as l", "'x' as half", "0 as shard")
    assert found(op.variants(df, shard_words=each)) == brute_variants(words)


def test_vocabulary_of_odd_texts(spark, frame, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(op, "STRETCH_BYTES", 3000)
    base = small_words(3, 40, "abé", (4, 8)) + ["ÉTÉÉÉ", "Straße×÷", "ſtraight", "naïve", "x" * 700, "Déjà"]
    rows = [(d if d % 7 else None, " ".join(r.choice(base) + r.choice(["", ".", "\n", "1", "日本"]) for _ in range(r.randrange(0, 200)))) for d in range(60)]
    rows += [(100, None), (101, ""), (102, "WORDS" * 2000 + " words"), (103, "long words " * 3000), (103, "long words " * 3000)]
    got = {x["word"]: x["n"] for x in op.vocabulary(frame(rows)).collect()}
    assert got == brute_vocabulary(rows)


def test_empty_tables(spark, frame):
    assert op.vocabulary(frame([])).collect() == []
    assert found(op.variants(op.vocabulary(frame([(1, None)])))) == {}


def test_all_documents_as_the_sql_and_by_brute_force(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.sql(f"select word, form, root, n, n_near, form_n from ({op.SQL})").fetchall()}
    got = found(op.op13_variants(spark, path))
    assert got == want
    vocabulary = brute_vocabulary([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()])
    assert {w: x[2] for w, x in got.items()} == vocabulary
    some = dict(sorted(vocabulary.items())[:1500])
    assert found(op.variants(spark.createDataFrame(list(some.items()), "word string, n long"))) == brute_variants(some)
