import math
import random

import pytest

from pulsespark.operators import intervals as iv
from pulsespark.operators import matching, metrics, trust
from pulsespark.streaming import monitor


def test_nearest_ties_and_missing(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0)], "rec string, t double")
    right = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 9.0)], "rec string, t double")
    got = {(r["rec"], r["t"]): r["match"] for r in matching.nearest(left, right).collect()}
    assert got == {("a", 1.0): 0.0, ("a", 5.0): 2.0, ("b", 2.0): None}


def test_extra_beat_is_found_and_removed(spark):
    t = [0.8 * i for i in range(20)]
    t[10] -= 0.3
    b = spark.createDataFrame([("r", i, x) for i, x in enumerate(t)], "rec string, beat int, t double")
    found = iv.extra_beats(iv.intervals(b))
    assert [r["beat"] for r in found.where("extra").collect()] == [10]
    kept = iv.without_extra_beats(found)
    assert kept.count() == 17 and all(abs(r["ibi"] - 0.8) < 1e-9 for r in kept.collect())


def test_short_records_and_nulls(spark):
    b = spark.createDataFrame([("one", 0, 1.0), ("none", 0, None)], "rec string, beat int, t double")
    v = {r["rec"]: r for r in iv.variability(iv.intervals(b)).collect()}
    assert v["one"]["n"] == 0 and v["one"]["rmssd"] is None and v["none"]["nrmssd"] is None
    assert iv.extra_beats(iv.intervals(b)).where("extra").count() == 0
    assert iv.sample_entropy(iv.clean(iv.intervals(b))).count() == 0


def test_fill_gaps_edges(spark):
    b = spark.createDataFrame([("r", i, float(i), v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "rec string, beat int, t double, v double")
    got = [r["f"] for r in matching.fill_gaps(b, "v", "t", "f", "beat").orderBy("beat").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1), ("a", None, 1)], "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in metrics.auc(rows, "s", rows["y"] == 1, "g").collect()}
    assert got == {"a": 0.875, "b": None}


def test_weights_fall_back_to_equal(spark):
    s = spark.createDataFrame([("r", p, i, float(p + i)) for p in range(2) for i in range(3)], "rec string, patch int, i int, v double")
    w = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 0.0)], "rec string, patch int, weight double")
    assert [r["fused"] for r in trust.fuse(s, w).orderBy("i").collect()] == [0.5, 1.5, 2.5]


def test_lone_and_constant_patches(spark):
    s = spark.createDataFrame([("lone", 0, i, float(i)) for i in range(4)] + [("two", p, i, float(i * p)) for p in range(2) for i in range(4)], "rec string, patch int, i int, v double")
    got = {(r["rec"], r["patch"]): r["consistency"] for r in trust.consistency(s).collect()}
    assert got[("lone", 0)] == 1.0 and got[("two", 0)] == 0.0


def test_windows_join_without_cross_product(spark):
    w = spark.createDataFrame([("r", 5), ("r", 12)], "rec string, start int")
    p = spark.createDataFrame([("r", t) for t in (4, 5, 14, 15, 21, 22)], "rec string, t int")
    j = matching.in_windows(p, w, 10)
    assert sorted((r["start"], r["t"]) for r in j.collect()) == [(5, 5), (5, 14), (12, 14), (12, 15), (12, 21)]
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entropy_of_a_metronome_is_zero(spark):
    b = spark.createDataFrame([("r", i, float(i)) for i in range(20)], "rec string, beat int, t double")
    assert iv.shannon_entropy(iv.clean(iv.intervals(b))).first()["entropy"] == 0
    p = iv.poincare(iv.clean(iv.intervals(b))).first()
    assert p["sd1_sd2"] == 0 and p["tpr"] == 0


def test_state_keeps_a_span(spark, tmp_path):
    import pyspark.sql.functions as F

    rows = [(1, 0.8 * i) for i in range(60)]
    for n, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, "rec long, t double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema("rec long, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = []
    q = monitor.rhythm_state(stream.withColumn("ts", F.current_timestamp())).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
    q.awaitTermination()
    last = max(got, key=lambda r: r["t"])
    assert math.isclose(last["rate"], 75) and last["n"] == 38 and last["irregular"] is False


def test_left_out_subjects_are_scored_by_others(spark):
    from pulsespark.operators import models

    rng = random.Random(0)
    rows = [(s, float(c), c + rng.gauss(0, 0.3), rng.random()) for s in range(4) for c in (0, 1) for _ in range(30)] + [(9, 1.0, None, 0.1)]
    df = spark.createDataFrame(rows, "subject int, af double, x double, q double")
    scored = models.leave_one_out(df.dropna(), ["x"], "af", "subject")
    assert scored.count() == 240
    sweep = {r["threshold"]: r for r in models.gating_sweep(scored, "q", [0.0, 0.5], "af").collect()}
    assert sweep[0.0]["auc"] > 0.95 and sweep[0.0]["coverage_1"] == 1 and 0.3 < sweep[0.5]["coverage_0"] < 0.7
    assert models.fit(df.where("af = 1"), ["x"], "af") is None
