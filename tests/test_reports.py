"""Edge cases of grids, orders and choices."""

from pyspark.sql import functions as F

from pulsespark.operators import reports as r


def test_resample_gaps_edges_and_ties(spark):
    rows = [(1, 0, 0, 0.0), (1, 1, 10, None), (1, 2, 20, 4.0), (1, 3, 24, 8.0), (2, 4, 5, 1.0), (3, 5, None, 1.0), (4, 6, 0, None), (4, 7, 8, None), (5, 8, 0, 3.0), (5, 9, 8, None)]
    got = {(x["rec"], x["g"]): x["value"] for x in r.resample(spark.createDataFrame(rows, "rec long, beat long, us long, v double"), 4).collect()}
    assert got == {(1, 0): 0.0, (1, 4): 0.8, (1, 8): None, (1, 12): None, (1, 16): 3.2, (1, 20): 4.0, (4, 0): None, (4, 4): None, (5, 0): None, (5, 4): None}
    assert r.resample(spark.createDataFrame([], "rec long, beat long, us long, v double"), 4).count() == 0


def test_a_long_pause_is_cut(spark):
    rows = [(1, 0, 0, 0.0), (1, 1, 30_000, 3.0)]
    got = r.resample(spark.createDataFrame(rows, "rec long, beat long, us long, v double"), 1).orderBy("g").collect()
    assert [x["g"] for x in got] == list(range(30_000)) and abs(got[10_000]["value"] - 1.0) < 1e-9


def test_natural_order(spark):
    names = ["rec10_2", "rec2_10", "rec2_9", "a", "rec", "", "10", "9"]
    got = [x[0] for x in spark.createDataFrame([(n,) for n in names], "n string").orderBy(r.natural_key(F.col("n"))).collect()]
    assert got == ["", "9", "10", "a", "rec", "rec2_9", "rec2_10", "rec10_2"]


def test_choice_without_a_fit_is_none(spark):
    shares = spark.createDataFrame([("AF", 1.0, 0.2), ("non-AF with extra beats", 0.5, 0.1)], "kind string, base double, s double")
    assert r.choose_removal(shares, ["s"], "base", 0.5).collect() == [("none",)]
    assert r.choose_removal(shares, ["s"], "base", 0.8).collect() == [("s",)]
    assert r.removal_name(0.20, None) == "cap0.2" and r.removal_name(0.3, 0.1) == "cap0.3_tol0.1"
