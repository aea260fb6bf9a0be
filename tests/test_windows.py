"""Window tables, removal settings, saved classifiers."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from pulsespark.operators import models, windows


def pulse(beats, fs, n):
    t = np.arange(n) / fs
    return sum(np.exp(-((t - b) ** 2) / 0.01) for b in beats)


def table(spark, records, fs=30.0):
    rows = [(r, i, None if x is None or np.isnan(x) else float(x)) for r, v in records.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "rec string, i int, v double")


def irregular(n, seed):
    return 0.4 + np.cumsum(np.random.default_rng(seed).uniform(0.4, 1.3, n))


def test_signal_windows_and_why_some_are_dropped(spark):
    n = 1000  # a whole window of 900 samples and a tail
    regular, random = np.arange(0.5, 33, 0.8), irregular(60, 1)
    gap = pulse(regular, 30, n)
    gap[100:250] = np.nan
    small = pulse(regular, 30, n)
    small[100:120] = np.nan
    records = {"regular": pulse(regular, 30, n), "random": pulse(random, 30, n), "gap": gap, "small": small, "flat": np.ones(n), "slow": pulse(np.arange(1, 33, 6.0), 30, n), "short": np.ones(100)}
    got = {r["rec"]: r for r in windows.signal_windows(table(spark, records), 30.0, 30.0).collect()}
    assert set(got) == set(records) - {"short"} and all(r["win"] == 0 for r in got.values())
    assert {k: r["dropped"] for k, r in got.items()} == {"regular": None, "random": None, "gap": "missing", "small": None, "flat": "flat", "slow": "few beats"}
    assert abs(got["regular"]["hr_bpm"] - 75) < 1 and abs(got["small"]["hr_bpm"] - 75) < 3
    assert got["regular"]["nrmssd"] < 0.05 < 0.2 < got["random"]["nrmssd"]
    assert got["regular"]["peak_share"] > got["random"]["peak_share"] and got["regular"]["beat_shape"] > 0.9
    assert got["flat"]["nrmssd"] is None and got["gap"]["hr_bpm"] is None


def test_windows_resampled_to_a_camera(spark):
    v = pulse(np.arange(0.5, 31, 0.8), 125, 3750)
    one = windows.signal_windows(table(spark, {"a": v}), 125.0, 30.0, camera_fs=30.0).first()
    assert abs(one["hr_bpm"] - 75) < 1 and one["nrmssd"] < 0.05


def test_beat_windows_are_whole_and_half_open(spark):
    beats = spark.createDataFrame([("a", k, float(k)) for k in range(0, 65)] + [("b", 0, 1.0), ("b", 1, None)], "rec string, beat int, t double")
    got = {(r["rec"], r["win"]): list(r["beats"]) for r in windows.beat_windows(beats, 30).collect()}
    assert got == {("a", 0): [float(k) for k in range(30)], ("a", 1): [float(k) for k in range(30, 60)]}


def plain_removal(beats, cap, tolerance):
    """The rule beat by beat."""
    ibis = np.diff(beats)
    extra, mid = [], {}
    for i in range(1, len(beats) - 1):
        around = np.concatenate([ibis[max(0, i - 9) : i - 1], ibis[i + 1 : i + 9]])
        if len(beats) >= 5 and len(around) >= 3:
            mid[i] = np.median(around)
            if ibis[i - 1] < 0.85 * mid[i] and ibis[i] > 0.95 * mid[i]:
                extra.append(i)
    if not extra or len(extra) > cap * len(beats):
        return ibis, len(extra), False
    if tolerance is not None:
        near = lambda i, k: not 0 <= k < len(ibis) or abs(ibis[k] / mid[i] - 1) <= tolerance
        extra = [i for i in extra if near(i, i - 2) and near(i, i + 1)]
        if not extra:
            return ibis, 0, False
    return np.delete(ibis, [k for i in extra for k in (i - 1, i)]), len(extra), True


@pytest.mark.parametrize("cap,tolerance", [(0.2, None), (0.5, None), (0.2, 0.1), (0.05, 0.3)])
def test_removal_of_extra_beats_row_by_row(cap, tolerance):
    r = np.random.default_rng(3)
    rows = []
    for k in range(60):
        b = np.cumsum(r.normal(0.8, 0.02 + 0.15 * (k % 3 == 0), r.integers(2, 40)))
        early = r.random(len(b)) < 0.08
        rows.append(np.sort(b - 0.3 * early))
    left, n, removed = windows.without_extra(windows.padded([np.diff(b) for b in rows]), cap, tolerance)
    for k, b in enumerate(rows):
        want, m, gone = plain_removal(b, cap, tolerance)
        assert (n[k], bool(removed[k])) == (m, gone)
        assert np.allclose(left[k][~np.isnan(left[k])], want)
    assert removed.any() and not removed.all()


def test_removal_lowers_irregularity_of_isolated_extra_beats(spark):
    b = np.arange(0.0, 40, 0.8)
    b[10] -= 0.3
    b[25] -= 0.3
    rows = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(b)], "rec string, beat int, t double")
    got = {r["setting"]: r for r in windows.removal_rows(windows.beat_windows(rows, 30), {"cap20": (0.2, None), "cap1": (0.01, None)}).collect()}
    assert got["cap20"]["removed"] and got["cap20"]["n_extra"] == 2 and got["cap20"]["nrmssd"] < 0.01 < got["none"]["nrmssd"]
    assert not got["cap1"]["removed"] and got["cap1"]["nrmssd"] == got["none"]["nrmssd"]
    one = windows.window_rows(windows.beat_windows(rows, 30), cap=0.2).first()
    assert one["extra_removed"] and one["n_extra"] == 2 and one["nrmssd"] < 0.01


def test_a_loaded_bundle_gives_the_same_decisions(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"r{k}", w, *(x + (k % 2) for x in rng.normal(0, 0.2, 2).tolist()), float(k % 2), 0.9 if w else 0.1) for k in range(20) for w in range(4)]
    df = spark.createDataFrame(rows, "rec string, win int, a double, b double, af double, quality double")
    df = df.withColumn("b", F.when((F.col("rec") == "r3") & (F.col("win") == 2), None).otherwise(F.col("b")))
    bundle = models.train(df, ["a", "b"], "af", {"least_quality": 0.5, "window_s": 30})
    models.save(bundle, str(tmp_path / "m"))
    loaded = models.load(spark, str(tmp_path / "m"))
    assert loaded.info == bundle.info and loaded.info["features"] == ["a", "b"]
    before, after = ({r["rec"]: r["decision"] for r in models.decide(models.screen(df, x), "rec").collect()} for x in (bundle, loaded))
    assert before == after == {f"r{k}": "possible AF" if k % 2 else "regular rhythm" for k in range(20)}
    row = models.screen(df, loaded).where("rec = 'r3' AND win = 2").first()
    assert row["p"] is None and row["b"] is None and not row["reliable"]
    assert models.decide(models.screen(df.where("win = 0"), loaded), "rec").where("decision = 'unreliable'").count() == 20
    assert models.train(df.where("af = 1"), ["a", "b"], "af", {}) is None


def test_empty_tables(spark):
    beats = spark.createDataFrame([], "rec string, beat int, t double")
    assert windows.window_rows(windows.beat_windows(beats, 30)).collect() == []
    assert windows.removal_rows(windows.beat_windows(beats, 30), {"cap20": (0.2, None)}).collect() == []
    assert windows.signal_windows(spark.createDataFrame([], "rec string, i int, v double"), 30.0, 30.0).collect() == []


def test_surroundings_and_pairs_of_long_windows_take_bounded_memory():
    import tracemalloc

    ibis = np.random.default_rng(1).uniform(0.3, 2.0, (2, 6000))
    short = ibis[:, :700]
    tracemalloc.start()
    windows.extra_of(np.repeat(ibis, 20, axis=0))
    windows.rhythm_features(ibis)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    whole = windows.extra_of(short), windows.rhythm_features(short)
    cells, windows.CELLS = windows.CELLS, 5000  # blocks of a few columns give the same
    try:
        again = windows.extra_of(short), windows.rhythm_features(short)
    finally:
        windows.CELLS = cells
    for a, b in zip(whole, again, strict=True):
        for x, y in zip(a, b, strict=True):
            np.testing.assert_array_equal(x, y)
    around = np.delete(short[0, :18], [8, 9])
    assert whole[0][1][0, 8] == np.median(around)


def test_rows_are_scored_in_bounded_parts():
    import pyarrow as pa

    lengths = [3, 5] * 5000 + [100_000, 0, 7]
    batch = pa.record_batch({"x": pa.array([None if n == 7 else [0.5] * n for n in lengths], pa.list_(pa.float64())), "n": lengths})
    got = list(windows.parts(batch, "x"))
    assert [n for rows, _ in got for n in rows.column("n").to_pylist()] == lengths
    assert [len(v) for _, values in got for v in values] == [0 if n == 7 else n for n in lengths]
    assert max(len(v) * max(map(len, v)) for _, v in got if len(v) > 1) <= windows.VALUES


def test_mapped_windows_come_in_bounded_parts(spark):
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "transform(sequence(1, 50), x -> x * 0.8) AS t")
    got = windows._map(rows, "t", [("held", "long")], lambda values: [[len(values) * 50] * len(values)]).collect()
    assert len(got) == 4000 and max(r["held"] for r in got) <= windows.VALUES
