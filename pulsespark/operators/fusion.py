"""Fusion of patches in sliding windows, agreement of beats, and removal of what head motion explains.

A window of a record is the unit of work: samples are copied to the windows they lie in (length / step times), each window
meets in one task with all its patches, and gives one row. Records of any length are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulsespark.functions import kernels
from pulsespark.operators import trust
from pulsespark.settings import BRIGHT, DARK, FACING_MIN, PULSE_BAND

#: Strength of the ridge (times the samples of a window).
RIDGE = 0.1
#: Seconds that a beat of a patch and one of the others may be apart.
BEAT_APART = 0.1
#: Degrees (the first three channels) and centimetres (the others) of root-mean-square movement that count as motion.
LEAST_MOTION = (1.0, 1.0, 1.0, 0.5, 0.5, 0.5)
#: Degrees a second at which the confidence in a still head is one half.
STILL = 5.0
ENOUGH_PATCHES = 0.3


# ---------------------------------------------------------------- windows


def sliding(rows: DataFrame, length: int, step: int, key: str = "rec", i: str = "i") -> DataFrame:
    """rows, once for each window they lie in, with `start` and `length`: windows of `length` samples every `step`, and one
    more that ends with the record where the last of them does not. A shorter record is one window. Samples are numbered
    from 0."""
    ends = rows.groupBy(key).agg((F.max(i) + 1).alias("_n"))
    r = rows.join(ends, key).withColumn("length", F.least(F.lit(length), F.col("_n")).cast("int"))
    last = F.col("_n") - F.col("length")
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - F.col("length") + 1) / step)).cast("int")
    to = F.least(F.floor(F.col(i) / step), F.floor(last / step)).cast("int")
    regular = F.when(to >= first, F.transform(F.sequence(first, to), lambda k: (k * step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    forced = F.when((last % step != 0) & (F.col(i) >= last), F.array(last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return r.withColumn("start", F.explode(F.concat(regular, forced))).drop("_n")


# ---------------------------------------------------------------- agreement of beats


def matches(beats: DataFrame, apart: float, *keys: str, t: str = "t", side: str = "side") -> DataFrame:
    """(keys, a, b, matches, f1) of beats(keys, t, side), sides 0 and 1: greedy one-to-one matches in time, at most `apart`.

    No match reaches over a pause of more than `apart` in both sides together, so times are cut there and each run, a few
    beats long, is matched alone: work is linear in the beats, and no task holds a record. f1 is null without beats.
    """
    w = Window.partitionBy(*keys).orderBy(t, side)
    cut = F.coalesce((F.col(t) - F.lag(t).over(w) > apart).cast("int"), F.lit(0))
    r = beats.where(F.col(t).isNotNull()).withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = r.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(side).cast("int").alias("s")))).alias("m"), F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))

    def step(z: Column, x: Column) -> Column:
        """Waiting beats are of one side; those too old for the next beat of the other side go."""
        wait = F.when(z["side"] == x["s"], z["wait"]).otherwise(F.filter(z["wait"], lambda y: x["t"] - y <= apart))
        hit = (z["side"] != x["s"]) & (F.size(wait) > 0)
        rest = F.when(hit, F.slice(wait, 2, F.greatest(F.size(wait), F.lit(1)))).otherwise(F.concat(wait, F.array(x["t"])))
        return F.struct((z["n"] + hit.cast("int")).alias("n"), rest.alias("wait"), F.when(hit, z["side"]).otherwise(x["s"]).alias("side"))

    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<double>").alias("wait"), F.lit(-1).alias("side"))
    one = (F.col("a") == 0) | (F.col("b") == 0)
    n = F.when(one, 0).otherwise(F.aggregate("m", empty, step, lambda z: z["n"])).cast("long")
    g = g.withColumn("n", n).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("matches"))
    return g.withColumn("f1", F.try_divide(2.0 * F.col("matches"), F.col("a") + F.col("b")))


def match_count(a: np.ndarray, b: np.ndarray, apart: float) -> int:
    """The same of two short sorted arrays."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= apart:
            n, i, j = n + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return n


def maxima(x: np.ndarray) -> np.ndarray:
    """Samples above the one before and not below the one after."""
    return np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1


# ---------------------------------------------------------------- fusion


def window_weights(seg: np.ndarray, base: np.ndarray, find, apart: float | None = BEAT_APART, power: float = 2.0, find_all=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, consistency, agreement) of the patches of a window: seg (time, patches) of unit deviation, base weights.

    find gives the times of a signal's beats, find_all (if given) those of each of many signals (signals, time). Consistency is the correlation with the weighted sum of all others (0 to 1), agreement the share of beats that match
    those of the others. Where they leave no weight, the base does.
    """
    n = seg.shape[1]
    find_all = find_all or (lambda x: [find(y) if y.any() else np.zeros(0) for y in x])
    if n < 2:
        return np.ones(n), np.ones(n), np.ones(n)
    share = base / base.sum()
    others = (seg @ share)[:, None] - seg * share
    a, b = seg - seg.mean(0), others - others.mean(0)
    norm = np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0)
    consistency = np.clip(np.where(norm > 0, (a * b).sum(0) / np.where(norm > 0, norm, 1), 0), 0, 1)
    weights, agreement = base * consistency**power, np.ones(n)
    if apart is not None:
        share = weights / weights.sum() if weights.sum() > 0 else share
        total = seg @ share
        for at in range(0, n, 256):
            own = seg[:, at : at + 256].T
            others = total - share[at : at + 256, None] * own
            for k, (a, b) in enumerate(zip(find_all(own), find_all(others), strict=True), at):
                agreement[k] = 2 * match_count(a, b, apart) / max(len(a) + len(b), 1)
        weights = weights * agreement
    return (weights if weights.sum() > 0 else base) / (weights if weights.sum() > 0 else base).sum(), consistency, agreement


def fuse_windows(samples: DataFrame, fs: float, length: int, step: int, apart: float | None = BEAT_APART, find=None, min_valid: float = 0.5, power: float = 2.0) -> DataFrame:
    """samples(rec, patch, i, v[, facing, luma]) -> a row for each window: rec, start, patches, weights, consistency,
    agreement (arrays by patch), fused (array by sample), agreed, coverage, shape.

    A patch counts if at least min_valid of its samples in the window are known and vary; unknown ones are 0. Base weights
    are facing times brightness, means over the window, where the columns are there; if they leave nothing, all patches
    that count weigh alike. A window without any gives no row. `find` (signal -> times in seconds) may stand for the usual
    search of beats; apart=None leaves agreement out, power=0 consistency. One shuffle, by (record, window).
    """
    find_all = None if find else (lambda x: kernels.detect_all(x, fs))
    find = find or (lambda x: kernels.detect_beats(x, fs))
    optional = [c for c in ("facing", "luma") if c in samples.columns]
    rows = sliding(samples.select("rec", "patch", "i", "v", *optional), length, step)
    kinds = dict(samples.dtypes)
    out = T.StructType.fromDDL(f"rec {kinds['rec']}, start long, patches array<{kinds['patch']}>, weights array<double>, consistency array<double>, agreement array<double>, fused array<double>, agreed double, coverage double, shape double")
    out_schema = to_arrow_schema(out)

    def run(key, table):
        start, n = int(key[1].as_py()), int(table["length"][0].as_py())
        names, who = np.unique(table["patch"].to_numpy(), return_inverse=True)
        at = table["i"].to_numpy() - start

        def matrix(column):
            out = np.full((n, len(names)), np.nan)
            out[at, who] = table[column].cast(pa.float64()).to_numpy(zero_copy_only=False)
            return out

        v = matrix("v")
        known = ~np.isnan(v)
        v = np.where(known, v, 0.0)
        deviation = v.std(0)
        use = (known.mean(0) >= min_valid) & (deviation > 0)
        if not use.any():
            return out_schema.empty_table()
        seg = np.where(use, v / np.where(deviation > 0, deviation, 1), 0.0)
        base = use.astype(float)
        for c in optional:
            x = matrix(c)
            m = np.where(np.isnan(x).all(0), 0.0, np.nansum(x, 0) / np.maximum((~np.isnan(x)).sum(0), 1))
            base = base * (np.where(m < FACING_MIN, 0.0, m) if c == "facing" else np.clip((m - DARK[0]) / (DARK[1] - DARK[0]), 0, 1) * (1 - np.clip((m - BRIGHT[0]) / (BRIGHT[1] - BRIGHT[0]), 0, 1)))
        if base.sum() <= 0:
            base = use.astype(float)
        w, consistency, agreement = window_weights(seg, base, find, apart, power, find_all)
        fused = seg @ w
        agreed = float((w * consistency).sum()) if len(names) > 1 else 1.0
        coverage = min(1.0, 1 / float((w**2).sum()) / max(1.0, ENOUGH_PATCHES * len(names)))
        shape = kernels.beat_shape(fused, fs, find(fused))
        return pa.table({"rec": [key[0].as_py()], "start": [start], "patches": [names.tolist()], "weights": [w.tolist()], "consistency": [consistency.tolist()], "agreement": [agreement.tolist()], "fused": [fused.tolist()], "agreed": [agreed], "coverage": [coverage], "shape": [shape]}, schema=out_schema)

    return rows.groupBy("rec", "start").applyInArrow(run, out)


def confidence(*parts: Column) -> Column:
    """Geometric mean of the parts of a window's confidence (agreed, shape, stillness, coverage), each 0 to 1."""
    return trust.geometric_mean(*parts)


def stillness(pose: DataFrame, fs: float, channels: list[str], length: int, step: int, half: float = STILL) -> DataFrame:
    """pose(rec, i, channels) -> (rec, start, speed, still): mean speed of the channels together in each window, a second,
    and 1 / (1 + (speed / half) ** 2)."""
    w = Window.partitionBy("rec").orderBy("i")

    def slope(c: str) -> Column:
        a, b, x = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
        return F.coalesce(F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2.0), F.lit(0.0)) * fs

    speed = F.sqrt(sum((F.pow(F.col(f"_{c}"), F.lit(2.0)) for c in channels), F.lit(0.0)))
    p = pose.select("rec", "i", *[slope(c).alias(f"_{c}") for c in channels]).withColumn("speed", speed)
    g = sliding(p.select("rec", "i", "speed"), length, step).groupBy("rec", "start").agg(F.avg("speed").alias("speed"))
    return g.withColumn("still", 1 / (1 + F.pow(F.col("speed") / half, F.lit(2.0))))


# ---------------------------------------------------------------- motion


def motion_regressors(pose: DataFrame, fs: float, band: tuple[float, float] = PULSE_BAND, least: tuple[float, ...] = LEAST_MOTION, window_s: float = 8.0) -> DataFrame:
    """pose(rec, channels array<array<double>>), a packed signal of each channel -> (rec, i, x array, active array): band-passed
    channels and their slopes, and for each of these whether its channel really moves around the sample.

    Small movements are mostly errors of the estimate, which follow the pulse; regressing on them would take the pulse
    away. A record with a channel that is nowhere known gives no rows.
    """
    half = max(3, int(round(window_s * fs / 2)))

    def run(batches):
        for batch in batches:
            for rec, channels in zip(batch.column("rec"), batch.column("channels").to_pylist(), strict=True):
                x = np.array([[np.nan if v is None else v for v in c] for c in channels or []], float)
                if x.ndim < 2 or x.shape[1] < 2 or np.isnan(x).all(1).any():
                    continue
                at = np.arange(x.shape[1])
                x = np.array([np.interp(at, at[~np.isnan(c)], c[~np.isnan(c)]) for c in x])
                moved = kernels.bandpass(kernels.detrend(x), fs, band)
                rms = np.sqrt(moving_mean(moved**2, half))
                active = rms >= np.array(least[: len(x)])[:, None]
                both = kernels.bandpass(kernels.detrend(np.concatenate([x, np.gradient(x, axis=1) * fs])), fs, band)
                yield pa.RecordBatch.from_arrays([pa.array([rec.as_py()] * len(at), rec.type), pa.array(at, pa.int64()), pa.array(both.T.tolist(), pa.list_(pa.float64())), pa.array(np.concatenate([active, active]).T.tolist(), pa.list_(pa.bool_()))], names=["rec", "i", "x", "active"])

    kind = dict(pose.dtypes)["rec"]
    return pose.select("rec", "channels").mapInArrow(run, f"rec {kind}, i long, x array<double>, active array<boolean>")


def moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over `size` samples around each, the ends held on."""
    left = size // 2
    padded = np.pad(x, ((0, 0), (left, size - 1 - left)), mode="edge")
    sums = np.cumsum(np.pad(padded, ((0, 0), (1, 0))), axis=1)
    return (sums[:, size:] - sums[:, :-size]) / size


def remove_explained(rows: DataFrame, y: list[str], x: list[str], *keys: str, ridge: float = RIDGE, active: dict[str, str] | None = None) -> DataFrame:
    """rows with each column of y less what a ridge regression on the standardized columns x explains, group by group.

    Means, variances and covariances are combinable aggregates, so a group is never gathered; one small system a group is
    solved, and joined back. y is taken as it is, without its mean; a column of x that does not vary explains nothing. With
    `active`, a column of x counts only in groups where its boolean column holds in half the rows or more. Rows where any of
    y or x is unknown are left out of the sums and keep their y.
    """
    known = F.lit(True)
    for c in [*y, *x]:
        known = known & F.col(c).isNotNull()
    cell = lambda c: F.when(known, F.col(c))
    active = active or {}
    sums = [F.avg(cell(c)).alias(f"_m_{c}") for c in x]
    sums += [F.covar_pop(cell(a), cell(b)).alias(f"_c_{k}_{j}") for k, a in enumerate(x) for j, b in enumerate(x) if k <= j]
    sums += [F.covar_pop(cell(a), cell(b)).alias(f"_b_{k}_{j}") for k, a in enumerate(x) for j, b in enumerate(y)]
    sums += [(F.avg(F.col(active[c]).cast("double")) >= 0.5 if c in active else F.lit(True)).alias(f"_u_{c}") for c in x]
    g = rows.groupBy(*keys).agg(*sums)
    n, m = len(x), len(y)
    kinds = dict(rows.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_mean array<double>", "_beta array<array<double>>"])

    def solve(batches):
        for batch in batches:
            take = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            cov = np.zeros((batch.num_rows, n, n))
            for k in range(n):
                for j in range(k, n):
                    cov[:, k, j] = cov[:, j, k] = np.nan_to_num(take(f"_c_{k}_{j}"))
            b = np.array([[np.nan_to_num(take(f"_b_{k}_{j}")) for j in range(m)] for k in range(n)]).reshape(n, m, -1).transpose(2, 0, 1)
            deviation = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
            use = np.stack([batch.column(f"_u_{c}").to_numpy(zero_copy_only=False).astype(bool) for c in x], 1) & (deviation > 1e-9)
            scale = np.where(use, 1 / np.where(use, deviation, 1), 0)
            z = cov * scale[:, :, None] * scale[:, None, :] + ridge * np.eye(n)
            beta = np.linalg.solve(z, b * scale[:, :, None]) * scale[:, :, None]
            mean = np.nan_to_num(np.stack([take(f"_m_{c}") for c in x], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(beta.transpose(0, 2, 1).tolist(), pa.list_(pa.list_(pa.float64())))], names=[*keys, "_mean", "_beta"])

    fitted = rows.join(g.mapInArrow(solve, out), list(keys))
    explained = lambda j: sum(((F.col(c) - F.col("_mean")[k]) * F.col("_beta")[j][k] for k, c in enumerate(x)), F.lit(0.0))
    return fitted.withColumns({c: F.when(known, F.col(c) - explained(j)).otherwise(F.col(c)) for j, c in enumerate(y)}).drop("_mean", "_beta")


def explained_in_windows(y: np.ndarray, x: np.ndarray, active: np.ndarray, n: int, length: int, ridge: float = RIDGE) -> np.ndarray:
    """What the regressors x (time, columns) explain of the signals y (signals, time), in half-overlapping windows of a record of
    n samples, overlap-added: `remove_motion_from_colour` for arrays."""
    length = min(length, n)
    step, last = max(1, length // 2), n - length
    taken, total = np.zeros_like(y), np.zeros(y.shape[1])
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, length + 1) / (length + 1))
    for start in [*range(0, last + 1, step), *([last] if last % step else [])]:
        a, b = x[start : start + length], y[:, start : start + length]
        if not len(a):
            continue
        d = a - a.mean(0)
        cov = d.T @ d / len(a)
        deviation = np.sqrt(np.diagonal(cov))
        use = (active[start : start + length].mean(0) >= 0.5) & (deviation > 1e-9)
        total[start : start + length] += h[: len(a)]
        if not use.any():
            continue
        scale = np.where(use, 1 / np.where(use, deviation, 1), 0)
        z = cov * scale[:, None] * scale + ridge * np.eye(len(scale))
        beta = np.linalg.solve(z, d.T @ (b - b.mean(1)[:, None]).T / len(a) * scale[:, None]) * scale[:, None]
        taken[:, start : start + length] += (d @ beta).T * h[: len(a)]
    return taken / np.maximum(total, 1e-9)


def overlap_add(windows: DataFrame, value: str = "v") -> DataFrame:
    """(rec, i, v) of windows(rec, start, i, length, v): sums under a Hann window without its zero ends, over its sum."""
    h = 0.5 - 0.5 * F.cos(F.lit(2 * np.pi) * (F.col("i") - F.col("start") + 1) / (F.col("length") + 1))
    w = windows.withColumn("_h", h)
    return w.groupBy("rec", "i").agg((F.sum(F.col(value) * F.col("_h")) / F.greatest(F.sum("_h"), F.lit(1e-9))).alias("v"))


def remove_motion_from_colour(colours: DataFrame, motion: DataFrame, fs: float, length: int, channels: int, ridge: float = RIDGE) -> DataFrame:
    """colours(rec, patch, i, y, v) with v less the part of its band-passed form y that motion explains, in half-overlapping
    windows. motion as `motion_regressors` gives it, with `channels` columns; windows where none of them moves stay as
    they are. v is a colour over its mean less 1."""
    names = [f"_x{k}" for k in range(channels)]
    m = motion.select("rec", "i", *[F.col("x")[k].alias(f"_x{k}") for k in range(channels)], *[F.col("active")[k].alias(f"_a{k}") for k in range(channels)])
    rows = sliding(colours.join(m, ["rec", "i"]), length, max(1, length // 2)).withColumn("_left", F.col("y"))
    left = remove_explained(rows, ["_left"], names, "rec", "patch", "start", ridge=ridge, active={f"_x{k}": f"_a{k}" for k in range(channels)})
    h = 0.5 - 0.5 * F.cos(F.lit(2 * np.pi) * (F.col("i") - F.col("start") + 1) / (F.col("length") + 1))
    taken = left.withColumn("_h", h).groupBy("rec", "patch", "i").agg((F.sum((F.col("y") - F.col("_left")) * F.col("_h")) / F.greatest(F.sum("_h"), F.lit(1e-9))).alias("_taken"), F.first("v").alias("v"))
    return taken.select("rec", "patch", "i", (F.col("v") - F.coalesce("_taken", F.lit(0.0))).alias("v"))
