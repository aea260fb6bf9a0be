"""The whole analysis on synthetic faces, alignment of references."""

import numpy as np
import pyspark.sql.functions as F
import pytest

from pulsespark.functions import kernels
from pulsespark.operators import alignment, analysis

FS = 30.0


def face(spark, per_minute=72, seconds=16, patches=5, motion=0.0, seed=0, rec="r"):
    """Patches whose colours carry a pulse; patch 1 is noise, patch 2 dark, patch 3 unknown for the most part."""
    r = np.random.default_rng(seed)
    n = int(FS * seconds)
    t = np.arange(n) / FS
    beat = np.sin(2 * np.pi * per_minute / 60 * t) + 0.4 * np.sin(4 * np.pi * per_minute / 60 * t)
    head = np.sin(2 * np.pi * 1.7 * t)
    rows = []
    for p in range(patches):
        level = 12.0 if p == 2 else 120.0
        pulse = -0.003 * beat + motion * head if p != 1 else r.normal(0, 0.02, n)
        for i in range(n):
            if p == 3 and i % 10:
                rows.append((rec, p, i, None, None, None, 0.0, None))
            else:
                noise = r.normal(0, 0.0003, 3)
                rows.append((rec, p, i, *(float(level * (1 + g * pulse[i] + e)) for g, e in zip((0.4, 1.0, 0.6), noise, strict=True)), 500.0, 0.9))
    pose = spark.createDataFrame([(rec, i, float(5 * motion * 100 * head[i]), 0.01, 0.0) for i in range(n)], "rec string, i int, yaw double, pitch double, roll double")
    return spark.createDataFrame(rows, "rec string, patch int, i int, r double, g double, b double, n_px double, facing double"), pose


def test_full_analysis_finds_rate_beats_and_good_patches(spark):
    patches, pose = face(spark)
    a = analysis.analyse(patches, FS, "full", pose, ["yaw", "pitch", "roll"])
    r = a.records.collect()
    assert len(r) == 1 and abs(r[0]["rate"] - 72) < 1.5 and abs(r[0]["beats_rate"] - 72) < 1.5 and 16 <= len(r[0]["beats"]) <= 20
    w = a.windows.orderBy("start").collect()
    assert [x["start"] for x in w] == [30 * k for k in range(9)] and r[0]["n_windows"] == 9
    for x in w:
        weight = dict(zip(x["patches"], x["weights"], strict=True))
        assert set(weight) == {0, 1, 2, 4} and weight[2] == 0 and weight[1] < 0.1 < weight[0] and abs(x["rate"] - 72) < 4
    assert r[0]["confidence"] > 0.6 and abs(w[0]["centre_s"] - 4) < 1e-9
    assert len(a.pulse.first()["values"]) == 480


@pytest.mark.parametrize("variant", ["single_green", "single_chrom", "patch_mean"])
def test_simpler_variants(spark, variant):
    patches, _ = face(spark)
    good = patches.where("patch IN (0, 4)")
    a = analysis.analyse(good, FS, variant)
    assert abs(a.records.first()["rate"] - 72) < 2
    assert analysis.VARIANTS[variant].motion is False and list(analysis.VARIANTS)[-1] == "full"


def test_motion_is_removed_where_it_hides_the_pulse(spark):
    patches, pose = face(spark, motion=0.01)
    good = patches.where("patch IN (0, 4)")
    without = analysis.analyse(good, FS, "+beats", pose, ["yaw", "pitch", "roll"]).records.first()
    full = analysis.analyse(good, FS, "full", pose, ["yaw", "pitch", "roll"]).records.first()
    assert abs(without["rate"] - 102) < 3 and abs(full["rate"] - 72) < 3


def test_records_without_patches(spark):
    patches, _ = face(spark)
    assert analysis.analyse(patches.where("patch = 3"), FS, "+beats").records.collect() == []
    assert analysis.analyse(patches.limit(0), FS, "+beats").records.collect() == []


def test_levels_merge_by_pixels(spark):
    p = spark.createDataFrame([("r", 0, 0, 10.0, 0.0, 1.0, 1.0, 1.0), ("r", 1, 0, 20.0, 0.0, 1.0, 3.0, 0.5), ("r", 2, 0, None, 0.0, 1.0, 5.0, 0.5), ("r", 9, 0, 1.0, 1.0, 1.0, 1.0, 1.0)], "rec string, patch int, i int, r double, g double, b double, n_px double, facing double")
    got = {x["patch"]: (x["r"], x["n_px"], x["facing"]) for x in analysis.at_level(p, {0: 0, 1: 0, 2: 1}).collect()}
    assert got == {0: (17.5, 4.0, 0.625), 1: (None, 5.0, 0.5)}
    assert analysis.at_level(p, None).count() == 1


def test_wide_band_keeps_breathing(spark):
    t = np.arange(900) / FS
    g = 100 * (1 - 0.01 * np.sin(2 * np.pi * 1.2 * t) - 0.02 * np.sin(2 * np.pi * 0.25 * t))
    rows = [("r", 0, i, float(x)) for i, x in enumerate(g)] + [("r", 1, i, None if i % 3 else 50.0) for i in range(900)]
    df = spark.createDataFrame(rows, "rec string, patch int, i int, g double")
    v = np.array(analysis.wide_band_pulse(df, spark.createDataFrame([("r", 0, 0.0), ("r", 1, 1.0)], "rec string, patch int, weight double"), FS).first()["values"])
    assert abs(v.std() - 1) < 1e-6 and abs(np.corrcoef(v[90:-90], np.sin(2 * np.pi * 0.25 * t)[90:-90])[0, 1]) > 0.8


def test_pose_of_turns(spark):
    def matrix(yaw, pitch, roll, scale):
        a, b, c = np.radians([pitch, yaw, roll])
        x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
        y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
        z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
        return [float(v) for row in np.hstack([scale * z @ y @ x, [[1], [2], [3]]]) for v in row]

    df = spark.createDataFrame([(matrix(20, -10, 5, 3.0),), (matrix(-60, 30, 100, 0.5),)], "m array<double>")
    got = df.select(*analysis.pose_from_matrix([F.col("m")[k] for k in range(12)])).collect()
    assert np.allclose([list(r) for r in got], [[20, -10, 5, 1, 2, 3], [-60, 30, 100, 1, 2, 3]])


def test_references_by_time_number_and_stretch(spark):
    ref = spark.createDataFrame([("t", i, i / 10, float(i * i)) for i in range(5)] + [("s", i, None, float(i)) for i in range(3)] + [("w", i, None, float(i)) for i in range(5)] + [("one", 0, None, 7.0)], "rec string, i int, t double, v double")
    frames = spark.createDataFrame([("t", f, x) for f, x in enumerate((-1.0, 0.05, 0.3, 9.0))] + [("s", f, None) for f in range(3)] + [("w", f, None) for f in range(3)] + [("one", f, None) for f in range(2)], "rec string, frame int, t double")
    got = {}
    for r in alignment.to_frames(ref, frames).orderBy("rec", "frame").collect():
        got.setdefault(r["rec"], []).append(round(r["v"], 9))
    assert got == {"t": [0.0, 0.5, 9.0, 16.0], "s": [0.0, 1.0, 2.0], "w": [0.0, 2.0, 4.0], "one": [7.0, 7.0]}


def test_a_turned_and_late_reference_is_matched(spark):
    t = np.arange(200)
    y = np.sin(2 * np.pi * t / 37) + 0.3 * np.sin(2 * np.pi * t / 11)
    x = -np.roll(y, -5)
    df = spark.createDataFrame([("a", int(i), float(x[i]), float(y[i])) for i in t] + [("flat", 0, 1.0, 1.0), ("flat", 1, 1.0, 1.0)], "rec string, i int, x double, y double")
    rows = alignment.aligned(df, 8).where("rec = 'a'").orderBy("i").collect()
    assert {(r["lag"], r["sign"]) for r in rows} == {(5, -1)} and np.allclose([r["v"] for r in rows], y)


def test_short_and_dark_colours():
    t = np.arange(30) / 30
    rgb = 100 * (1 - np.outer(np.sin(2 * np.pi * 1.5 * t), [0.002, 0.006, 0.003]))
    assert np.abs(kernels.pos(rgb, 30.0)).max() > 0 and np.abs(kernels.chrom(rgb, 30.0)).max() > 0
    assert (kernels.pos(np.zeros((60, 3)), 30.0) == 0).all() and (kernels.chrom(np.zeros((60, 3)), 30.0) == 0).all()


def test_motion_of_packed_patches_as_by_rows(spark):
    from pulsespark.operators import fusion

    r = np.random.default_rng(5)
    n, length = 101, 48
    pose = spark.createDataFrame([(1, [(np.cumsum(r.normal(0, 2, n))).tolist(), (r.normal(0, 3, n)).tolist()])], "rec long, channels array<array<double>>")
    motion = fusion.motion_regressors(pose, 30.0)
    y, v = r.normal(0, 1, (2, n)), r.normal(0, 1, (2, n))
    rows = spark.createDataFrame([(1, k, i, float(y[k, i]), float(v[k, i])) for k in range(2) for i in range(n)], "rec long, patch long, i long, y double, v double")
    want = {(x["patch"], x["i"]): x["v"] for x in fusion.remove_motion_from_colour(rows, motion, 30.0, length, 4).collect()}
    m = motion.orderBy("i").collect()
    got = v - fusion.explained_in_windows(y, np.array([x["x"] for x in m]), np.array([x["active"] for x in m], float), n, length)
    assert len(want) == 2 * n and np.abs(got - v).max() > 0.05
    assert np.allclose(got, [[want[k, i] for i in range(n)] for k in range(2)], atol=1e-9)


def test_beats_and_rates_of_many_signals_as_one_by_one():
    from pulsespark.functions import kernels

    x = np.random.default_rng(6).normal(0, 1, (600, 48))
    x[7] = 0
    many = kernels.detect_all(x, 30.0)
    assert len(many[7]) == 0 and all(np.array_equal(a, kernels.detect_beats(y, 30.0)) for a, y in zip(many, x, strict=True))
    f, p = kernels.power_spectrum(x, 30.0)
    inside = (f >= kernels.PULSE_BAND[0]) & (f <= kernels.PULSE_BAND[1])
    assert np.array_equal(np.delete(kernels.peak_rate(x, 30.0), 7), np.delete(60 * f[inside][p[:, inside].argmax(axis=1)], 7))
