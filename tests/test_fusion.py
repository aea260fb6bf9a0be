"""Windowed fusion, agreement of beats and motion removal."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from pulsespark.functions import kernels
from pulsespark.operators import fusion


def long_form(spark, x, patches=None, **more):
    """x (time, patches) as rows (rec, patch, i, v, ...)."""
    rows = [("r", p if patches is None else patches[p], i, None if np.isnan(x[i, p]) else float(x[i, p]), *(float(m[i, p]) for m in more.values())) for i in range(len(x)) for p in range(x.shape[1])]
    return spark.createDataFrame(rows, ", ".join(["rec string", "patch int", "i int", "v double", *(f"{k} double" for k in more)]))


def pulses(n=300, fs=30.0, seed=0, noise=0.1, patches=6):
    t = np.arange(n) / fs
    clean = np.sin(2 * np.pi * 1.2 * t) + 0.3 * np.sin(4 * np.pi * 1.2 * t)
    return clean, clean[:, None] + noise * np.random.default_rng(seed).normal(size=(n, patches))


@pytest.mark.parametrize("n,length,step", [(64, 32, 12), (64, 32, 16), (10, 32, 8), (33, 32, 40), (1, 4, 2)])
def test_sliding_windows_with_a_forced_last(spark, n, length, step):
    rows = spark.createDataFrame([("r", i) for i in range(n)], "rec string, i int")
    got = {(r["start"], r["i"]) for r in fusion.sliding(rows, length, step).collect()}
    win = min(n, length)
    starts = list(range(0, n - win + 1, step))
    starts += [n - win] if starts[-1] + win < n else []
    assert got == {(s, i) for s in starts for i in range(s, s + win)}


def test_bad_patches_get_little_weight(spark):
    clean, x = pulses(patches=9)
    x[:, 2] = np.random.default_rng(1).normal(size=len(x))
    x[:, 3] = np.nan
    x[:, 4] = 7.0
    luma, facing = np.full(x.shape, 120.0), np.full(x.shape, 0.9)
    luma[:, 5], facing[:, 0] = 10.0, 0.1
    rows = fusion.fuse_windows(long_form(spark, x, luma=luma, facing=facing), 30.0, 240, 30).orderBy("start").collect()
    assert [r["start"] for r in rows] == [0, 30, 60]
    for r in rows:
        w = dict(zip(r["patches"], r["weights"], strict=True))
        assert abs(sum(w.values()) - 1) < 1e-9 and w[0] == w[3] == w[4] == w[5] == 0 and w[2] < 0.05 and w[1] > 0.2
    good = fusion.fuse_windows(long_form(spark, pulses()[1]), 30.0, 240, 30).collect()
    assert all(abs(np.corrcoef(r["fused"], clean[r["start"] : r["start"] + 240])[0, 1]) > 0.99 and r["agreed"] > 0.95 and r["coverage"] == 1 and r["shape"] > 0.9 for r in good)
    assert good[0]["shape"] > rows[0]["shape"] - 0.2


def test_one_patch_and_no_patch(spark):
    _, x = pulses(patches=1)
    one = fusion.fuse_windows(long_form(spark, x), 30.0, 240, 240).first()
    assert one["weights"] == [1.0] and one["agreed"] == 1.0
    assert fusion.fuse_windows(long_form(spark, np.full((50, 2), np.nan)), 30.0, 240, 30).collect() == []
    assert fusion.fuse_windows(long_form(spark, x[:0]), 30.0, 240, 30).collect() == []


def plain_matches(a, b, apart):
    return fusion.match_count(np.sort(a), np.sort(b), apart)


def test_matches_as_by_two_pointers(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(40):
        a, b = r.uniform(0, [5, 40][k % 2], r.integers(0, 40)).round(2), r.uniform(0, [5, 40][k % 2], r.integers(0, 40)).round(2)
        rows += [(k, float(t), s) for s, x in ((0, a), (1, b)) for t in x]
        if len(a) + len(b):
            want[k] = (len(a), len(b), plain_matches(a, b, 0.155))
    got = fusion.matches(spark.createDataFrame([*rows, (99, None, 0)], "rec int, t double, side int"), 0.155, "rec")
    assert {x["rec"]: (x["a"], x["b"], x["matches"]) for x in got.collect()} == want
    assert got.where("abs(f1 - 2 * matches / (a + b)) < 1e-9").count() == len(want)


def test_agreement_falls_where_beats_do_not_line_up():
    clean, x = pulses(noise=0.02, patches=4)
    x[:, 3] = np.roll(clean, 12)  # the same waves, 0.4 s later
    seg = x / x.std(0)
    _, _, agreement = fusion.window_weights(seg, np.array([1.0, 1.0, 1.0, 0.01]), lambda v: kernels.detect_beats(v, 30.0))
    assert min(agreement[:3]) > 0.9 and agreement[3] < 0.3


def test_ridge_takes_away_what_motion_explains(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    own = np.sin(np.arange(400) / 5)
    y = own + 2 * x[:, 0] - 1.5 * x[:, 1] + 3
    rows = spark.createDataFrame([(i // 200, i, float(y[i]), *x[i].tolist(), i < 200, True) for i in range(400)] + [(0, 999, None, 1.0, 1.0, 1.0, True, True)], "g int, i int, y double, a double, b double, c double, moves boolean, t boolean").withColumn("flat", F.lit(5.0))
    got = {k["i"]: k["y"] for k in fusion.remove_explained(rows, ["y"], ["a", "b", "c", "flat"], "g", ridge=0.01, active={"b": "moves"}).collect()}
    for g in range(2):
        i = np.arange(200 * g, 200 * g + 200)
        use = [0, 1, 2] if g == 0 else [0, 2]  # b moves in the first group only
        z = (x[i] - x[i].mean(0))[:, use] / x[i].std(0)[use]
        beta = np.linalg.solve(z.T @ z + 0.01 * 200 * np.eye(len(use)), z.T @ y[i])
        assert np.allclose([got[k] for k in i], y[i] - z @ beta)
    assert got[999] is None
    assert np.corrcoef([got[k] for k in range(200)], own[:200])[0, 1] > 0.99


def test_motion_regressors_tell_movement_from_jitter(spark):
    t = np.arange(600) / 30
    moving, jitter = 5 * np.sin(2 * np.pi * 1.0 * t), 0.05 * np.sin(2 * np.pi * 1.1 * t)
    gap = moving.copy()
    gap[100:110] = np.nan
    cells = lambda *c: [[None if np.isnan(v) else float(v) for v in x] for x in c]
    pose = spark.createDataFrame([("a", cells(gap, jitter)), ("none", cells(moving, np.full(600, np.nan)))], "rec string, channels array<array<double>>")
    rows = fusion.motion_regressors(pose, 30.0).collect()
    assert {r["rec"] for r in rows} == {"a"} and len(rows) == 600 and len(rows[0]["x"]) == 4
    active = np.array([r["active"] for r in rows])
    assert active[:, [0, 2]].all() and not active[:, [1, 3]].any()


def test_motion_is_taken_from_colours_before_the_pulse(spark):
    t = np.arange(480) / 30
    heart, head = 0.01 * np.sin(2 * np.pi * 1.3 * t), np.sin(2 * np.pi * 0.9 * t + 1)
    colour = heart + 0.05 * head
    pose = spark.createDataFrame([("r", [(5 * head).tolist()])], "rec string, channels array<array<double>>")
    y = kernels.bandpass(colour, 30.0)[0]
    rows = spark.createDataFrame([("r", 0, int(i), float(y[i]), float(colour[i])) for i in range(480)], "rec string, patch int, i long, y double, v double")
    left = fusion.remove_motion_from_colour(rows, fusion.motion_regressors(pose, 30.0), 30.0, 240, 2, ridge=0.01).orderBy("i").collect()
    v = np.array([r["v"] for r in left])
    assert len(v) == 480 and np.corrcoef(v[60:420], heart[60:420])[0, 1] > 0.9 > np.corrcoef(colour, heart)[0, 1]
    still = spark.createDataFrame([("r", [(0.01 * head).tolist()])], "rec string, channels array<array<double>>")
    same = fusion.remove_motion_from_colour(rows, fusion.motion_regressors(still, 30.0), 30.0, 240, 2).orderBy("i").collect()
    assert np.allclose([r["v"] for r in same], colour)


def test_speed_of_a_turning_head(spark):
    pose = spark.createDataFrame([("r", i, 0.5 * i, 0.0) for i in range(60)] + [("s", i, 1.0, None) for i in range(60)], "rec string, i int, yaw double, pitch double")
    got = {(r["rec"], r["start"]): (round(r["speed"], 6), round(r["still"], 6)) for r in fusion.stillness(pose, 30.0, ["yaw", "pitch"], 30, 30).collect()}
    assert got == {("r", 0): (15.0, 0.1), ("r", 30): (15.0, 0.1), ("s", 0): (0.0, 1.0), ("s", 30): (0.0, 1.0)}
