import pytest

from pulsespark.llm import op5_mixing as m

SF = "/root/testdata/sf0.01"


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s]}
        if not over:
            return target | share
        target |= {s: epochs * sizes[s] for s in over}
        free -= over
    return target


def held(rows, docs):
    """rows: taken(); docs: (doc_id, size, source)."""
    sizes = {}
    for _, n, s in docs:
        sizes[s] = sizes.get(s, 0) + n
    target = water_fill(sizes)
    source = {d: s for d, _, s in docs}
    got = dict.fromkeys(sizes, 0)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[s] += r["taken"]
    for s, n in got.items():
        assert abs(n - target[s]) <= 1, (s, n, target[s])


def test_query_meets_targets_and_reruns_agree(spark):
    rows = m.op5_mixing(spark, SF).collect()
    docs = [(r["doc_id"], len(__import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held(rows, docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.op5_mixing(spark, SF).collect()))


def test_edge_cases(spark, frame):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (4, "x " * 500, None), (5, "y", "t"), (6, "z " * 40, "u"), (6, "z " * 40, "u")]
    df = frame(rows, "doc_id long, text string, source string")
    got = m.taken(m.mix_sources(df)).collect()
    assert len(got) == 7 and sum(r["taken"] for r in got if r["doc_id"] == 6) <= 240
    assert m.taken(m.mix_sources(frame([], "doc_id long, text string, source string"))).count() == 0
    one = m.taken(m.mix_sources(frame([(1, "a b", None)], "doc_id long, text string, source string"))).collect()
    assert [(r["size"], r["taken"]) for r in one] == [(2, 2)]


def test_mixed_documents(spark, frame):
    rows = [(i, "word " * (5 + i % 7), f"s{i % 3}") for i in range(90)]
    df = frame(rows, "doc_id long, text string, source string")
    got = m.apply_mix(df)
    assert got.columns == df.columns
    words = {r["source"]: r["n"] for r in got.selectExpr("source", "size(split(trim(text), ' ')) as n").groupBy("source").sum("n").toDF("source", "n").collect()}
    target = {r["source"]: r["target"] for r in m.mix_sources(df).join(df, "doc_id").select("source", "target").distinct().collect()}
    assert all(abs(words[s] - target[s]) < 30 for s in target)


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,)])
def test_targets(spark, weights):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 1}
    rows = m.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), weights).collect()
    want = water_fill(sizes, weights)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in rows)


def test_schedule_is_the_golden_ratio(spark):
    shares = [(1, 0.0, 0.62, 40), (2, 0.62, 0.6201, 3), (3, 0.6201, 2.0, 25)]
    plan = spark.createDataFrame(shares, "source_no int, low double, high double, need long")
    want, seen = set(), {}
    for i in range(64):
        point = i * m.GOLDEN - int(i * m.GOLDEN)
        no, _, _, need = next(s for s in shares if s[1] <= point < s[2])
        rank = seen.get(no, 0)
        seen[no] = rank + 1
        if rank < need:
            want.add((no, rank))
    want |= {(no, r) for no, _, _, need in shares for r in range(seen.get(no, 0), need)}
    got = [tuple(r) for r in m.schedule(plan, 64, 1).collect()]
    assert len(got) == len(want) and set(got) == want


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5, 6)], "doc_id long, text string, source string, _MIX_id int, _mix_copy int")
    got = m.apply_mix(df).collect()
    assert got and all(tuple(r) == (1, "a b c", "x", 5, 6) for r in got)
