"""From colours of skin patches to a pulse with its rate, beats and confidence: the steps of one variant, as one plan.

    patches (rec, patch, i, r, g, b, facing)  --level-->  groups of patches
    colours --motion removed in windows--> pulse of each patch --fused in sliding windows--> motion removed again
    windows --overlap-added--> pulse of the record --cleaned--> rate, beats, rate of each window

Steps before the windows work on one patch of one record, the others on one window; no task holds a whole record with all
its patches.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsespark.functions import kernels
from pulsespark.operators import fusion, trust
from pulsespark.operators.windows import _map
from pulsespark.streaming.monitor import shared_dir


@dataclass(frozen=True)
class Variant:
    """Which parts of the fusion are used. mode "single" merges all patches into one."""

    mode: str = "auto"
    facing: bool = True
    brightness: bool = True
    consistency: bool = True
    beats: bool = True
    motion: bool = True
    pulse: str = "pos"


_PLAIN = {"facing": False, "brightness": False, "consistency": False, "beats": False, "motion": False}
#: The ladder of variants, each with one part more, after two other ways to a pulse.
VARIANTS = {
    "single_green": Variant("single", **_PLAIN, pulse="green"),
    "single_chrom": Variant("single", **_PLAIN, pulse="chrom"),
    "single": Variant("single", **_PLAIN),
    "patch_mean": Variant(**_PLAIN),
    "+facing": Variant(**{**_PLAIN, "facing": True}),
    "+brightness": Variant(**{**_PLAIN, "facing": True, "brightness": True}),
    "+consistency": Variant(beats=False, motion=False),
    "+beats": Variant(motion=False),
    "full": Variant(),
}


@dataclass(frozen=True)
class Analysis:
    """windows: rec, start, centre_s, rate, weights and parts of confidence; pulse: rec, values; records: rec, rate,
    beats_rate, beats, confidence, n_windows."""

    windows: DataFrame
    pulse: DataFrame
    records: DataFrame


def at_level(patches: DataFrame, groups: dict[int, int] | None, weight: str = "n_px") -> DataFrame:
    """patches merged into groups (patch -> group; None: all into one): means of colours and facing weighted by pixels. The
    map of patches is a small fixed dimension. Patches that it doesn't name are left out."""
    if groups is None:
        p = patches.withColumn("patch", F.lit(0))
    else:
        named = patches.sparkSession.createDataFrame(sorted(groups.items()), "patch int, _group int")
        p = patches.join(F.broadcast(named), "patch").withColumn("patch", F.col("_group")).drop("_group")
    values = [c for c in ("r", "g", "b", "facing") if c in patches.columns]
    return trust.merge_weighted(p, weight, values, "rec", "patch", "i").withColumnRenamed("weight", weight)


def valid_patches(patches: DataFrame, least: float = 0.5) -> DataFrame:
    """patches of which at least that share of the samples has all colours."""
    known = F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    good = patches.groupBy("rec", "patch").agg(F.avg(known.cast("double")).alias("_known")).where(F.col("_known") >= least)
    return patches.join(good.select("rec", "patch"), ["rec", "patch"], "left_semi")


def _packed(rows: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, first, values): the columns of each group one after another in order of i, NaN where unknown."""
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *cells))).alias("s"))
    return g.select(*keys, F.concat(*[F.col(f"s.{c}") for c in columns]).alias("values"))


def _same_length(values: list[np.ndarray], f) -> list[np.ndarray]:
    """f(signals, time) of all signals of a length at once, in the order of the signals."""
    out, sizes = [None] * len(values), np.array([len(x) for x in values])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for k, y in zip(at, f(np.stack([values[k] for k in at])), strict=True):
            out[k] = y
    return out


def _filled(x: np.ndarray) -> np.ndarray:
    """Straight lines over gaps along the last axis; rows without a value become 0."""
    at = np.arange(x.shape[-1])
    out = np.zeros_like(x)
    for k, r in enumerate(x):
        known = np.isfinite(r)
        if known.any():
            out[k] = np.interp(at, at[known], r[known])
    return out


def patch_pulses(colours: DataFrame, fs: float, method: str = "pos", min_valid: float = 0.5) -> DataFrame:
    """colours(rec, patch, i, r, g, b), or packed as `without_motion` gives them -> (rec, patch, i, v): the detrended, band-passed pulse of each patch that is known in
    at least min_valid of its samples. Samples of a record are numbered from 0 without gaps."""

    def pulse(values):
        out, raws = [None] * len(values), {}
        for k, x in enumerate(values):
            rgb = x.reshape(3, -1)
            if np.isfinite(rgb).all(0).mean() < min_valid:
                continue
            rgb = _filled(rgb).T
            raws[k] = -(rgb[:, 1] / (rgb[:, 1].mean() or 1) - 1) if method == "green" else getattr(kernels, method)(rgb, fs)
        for k, y in zip(raws, _same_length(list(raws.values()), lambda x: kernels.bandpass(kernels.detrend(x), fs)), strict=True):
            out[k] = y.tolist()
        return [out]

    packed = colours if "values" in colours.columns else _packed(colours, ["r", "g", "b"], "rec", "patch")
    got = _map(packed, "values", [("pulse", "array<double>")], pulse)
    return got.where("pulse IS NOT NULL").select("rec", "patch", F.posexplode("pulse").alias("i", "v"))


def without_motion(colours: DataFrame, motion: DataFrame, fs: float, length: int, channels: int) -> DataFrame:
    """colours(rec, patch, i, r, g, b) less what motion explains of each normalized colour, band-passed, in windows: packed as
    (rec, patch, values), three colours one after another, NaN where unknown. As `fusion.remove_motion_from_colour`, but a
    patch is one row with its record's regressors beside it, so samples are not copied to their windows in shuffles."""
    packed = _packed(colours, ["r", "g", "b"], "rec", "patch")
    sizes = packed.groupBy("rec").agg(F.max(F.size("values") / 3).alias("_n"))
    m = motion.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", "x", "active"))).alias("s"))
    flat = F.concat(F.flatten(F.col("s.x")), F.transform(F.flatten(F.col("s.active")), lambda a: a.cast("double")))
    m = m.join(sizes, "rec").select("rec", F.concat(flat, F.array(F.size("s").cast("double"), F.col("_n"))).alias("_m"))
    rows = packed.join(m, "rec").select("rec", "patch", F.concat("values", "_m").alias("values"))

    def clean(values):
        rgb, made = [], []
        for x in values:
            m, n = int(x[-2]), int(x[-1])
            at = len(x) - 2 - 2 * m * channels
            colour = _filled(x[:at].reshape(3, -1))
            mean = np.where(colour.mean(1) != 0, colour.mean(1), 1.0)
            rgb += list(colour / mean[:, None] - 1)
            made.append((mean[:, None], x[at : at + m * channels].reshape(m, channels), x[at + m * channels : -2].reshape(m, channels), min(m, n)))
        y = _same_length(rgb, lambda v: kernels.bandpass(v, fs))
        out = []
        for k, (mean, regressors, active, n) in enumerate(made):
            size = min(len(regressors), len(rgb[3 * k]))
            v, z = np.stack(rgb[3 * k : 3 * k + 3])[:, :size], np.stack(y[3 * k : 3 * k + 3])[:, :size]
            out.append(((1 + v - fusion.explained_in_windows(z, regressors[:size], active[:size], n, length)) * mean).ravel().tolist())
        return [out]

    return _map(rows, "values", [("_left", "array<double>")], clean).withColumnRenamed("_left", "values")


def _kept(rows: DataFrame) -> DataFrame:
    """rows as a table in the shared folder, written now."""
    path = f"{shared_dir(rows.sparkSession)}/analysis-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _rates(windows: DataFrame, fs: float) -> DataFrame:
    return _map(windows, "values", [("rate", "double")], lambda values: [[float(kernels.peak_rate(x[None, :], fs)[0]) if len(x) > 2 and x.std() > 0 else np.nan for x in values]])


def window_rates(pulse: DataFrame, centres: DataFrame, fs: float, length: int) -> DataFrame:
    """(rec, centre_s, rate) of pulse (rec, values) in windows of `length` samples around centres (rec, centre_s), moved inside
    the signal at its ends."""
    n = F.least(F.lit(length), F.size("values"))
    start = F.greatest(F.lit(0), F.least(F.bround(F.col("centre_s") * fs - n / 2).cast("int"), F.size("values") - n))
    w = centres.select("rec", "centre_s").join(pulse.select("rec", "values"), "rec")
    return _rates(w.select("rec", "centre_s", F.slice("values", start + 1, n).alias("values")), fs)


def pose_channels(pose: DataFrame, channels: list[str]) -> DataFrame:
    """(rec, channels): pose (rec, i, channels) as a packed signal of each channel."""
    g = pose.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", *channels))).alias("s"))
    return g.select("rec", F.array(*[F.col(f"s.{c}").cast("array<double>") for c in channels]).alias("channels"))


def analyse(patches: DataFrame, fs: float, variant: str | Variant = "full", pose: DataFrame | None = None, channels: list[str] | None = None, length_s: float = 8.0, step_s: float = 1.0) -> Analysis:
    """patches(rec, patch, i, r, g, b, n_px[, facing]) and pose(rec, i, channels) -> an Analysis by the variant.

    Samples are numbered from 0 without gaps in each record; unknown colours are null. Records without a patch that is
    known often enough give no rows.
    """
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    length, step = int(round(length_s * fs)), max(1, int(round(step_s * fs)))
    p = valid_patches(at_level(patches, None) if v.mode == "single" else patches)
    moves = v.motion and pose is not None
    colours = p.select("rec", "patch", "i", "r", "g", "b")
    if moves:
        regressors = fusion.motion_regressors(pose_channels(pose, channels), fs)
        columns = 2 * len(channels)
        colours = without_motion(colours, regressors, fs, length, columns)
    pulses = patch_pulses(colours, fs, v.pulse)
    sides = [F.col("facing").alias("facing")] if v.facing and "facing" in p.columns else []
    sides += [trust.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma")] if v.brightness else []
    if sides:
        pulses = pulses.join(p.select("rec", "patch", "i", *sides), ["rec", "patch", "i"])
    w = fusion.fuse_windows(pulses, fs, length, step, fusion.BEAT_APART if v.beats else None, power=2.0 if v.consistency else 0.0)
    w = _kept(w)  # read by the windows, the pulse and the records
    still = fusion.stillness(pose, fs, channels[:3], length, step).select("rec", "start", "still") if pose is not None else None
    w = w.join(still, ["rec", "start"], "left") if still is not None else w.withColumn("still", F.lit(1.0))
    w = w.withColumn("still", F.coalesce("still", F.lit(1.0))).withColumn("confidence", fusion.confidence(F.col("agreed"), F.col("shape"), F.col("still"), F.col("coverage")))
    w = w.withColumn("centre_s", (F.col("start") + F.size("fused") / 2) / fs)
    rows = w.select("rec", "start", F.size("fused").alias("length"), F.posexplode("fused").alias("k", "v")).select("rec", "start", "length", (F.col("start") + F.col("k")).alias("i"), "v")
    if moves:
        names = [f"x{k}" for k in range(columns)]
        r = regressors.select("rec", "i", *[F.col("x")[k].alias(f"x{k}") for k in range(columns)], *[F.col("active")[k].alias(f"a{k}") for k in range(columns)])
        rows = fusion.remove_explained(rows.join(r, ["rec", "i"], "left"), ["v"], names, "rec", "start", active={f"x{k}": f"a{k}" for k in range(columns)})
    fused = fusion.overlap_add(rows.select("rec", "start", "length", "i", "v"))

    def clean(values):
        x = [kernels.clean_pulse(y[None, :], fs)[0] for y in values]
        beats = [kernels.detect_beats(y, fs) for y in x]
        return [[y.tolist() for y in x], [float(kernels.peak_rate(y[None, :], fs)[0]) if y.std() > 0 else np.nan for y in x], [60 / float(np.diff(b).mean()) if len(b) > 2 else np.nan for b in beats], [b.tolist() for b in beats]]

    made = _map(_packed(fused, ["v"], "rec"), "values", [("values_", "array<double>"), ("rate", "double"), ("beats_rate", "double"), ("beats", "array<double>")], clean)
    pulse = made.select("rec", F.col("values_").alias("values"))
    records = made.drop("values_").join(w.groupBy("rec").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_windows")), "rec")
    windows = w.drop("fused").join(window_rates(pulse, w, fs, length), ["rec", "centre_s"])
    return Analysis(windows, pulse, records)


def wide_band_pulse(colours: DataFrame, weights: DataFrame, fs: float, band: tuple[float, float] = (0.1, 3.3), min_valid: float = 0.5) -> DataFrame:
    """(rec, values): the inverted green of the patches, over its mean less 1, summed by weights (rec, patch, weight), band-passed
    wide enough to keep breathing, of unit deviation. Patches known in less than min_valid of the samples are left out; where
    the weights leave nothing, the others count alike."""

    def normal(values):
        out = []
        for x in values:
            if np.isfinite(x).mean() < min_valid:
                out.append(None)
                continue
            g = _filled(x[None, :])[0]
            out.append((-(g / (g.mean() or 1) - 1)).tolist())
        return [out]

    g = _map(_packed(colours, ["g"], "rec", "patch"), "values", [("v", "array<double>")], normal).where("v IS NOT NULL")
    w = g.select("rec", "patch").join(weights, ["rec", "patch"], "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    samples = g.select("rec", "patch", F.posexplode("v").alias("i", "v"))
    fused = trust.fuse(samples, w)

    def filtered(values):
        out = []
        for x in values:
            y = kernels.bandpass(x - x.mean(), fs, band)[0]
            out.append((y / y.std() if y.std() > 0 else y).tolist())
        return [out]

    return _map(_packed(fused, ["fused"], "rec"), "values", [("w", "array<double>")], filtered).select("rec", F.col("w").alias("values"))


def pose_from_matrix(cells: list[Column]) -> list[Column]:
    """yaw, pitch, roll (degrees), x, y, z of a 4 x 4 (or 3 x 4) transformation, row by row: scale is taken out of the columns, and
    angles are those of turns about the fixed axes x, y, z in that order."""
    at = lambda r, c: cells[4 * r + c]
    size = [F.sqrt(sum((at(r, c) * at(r, c) for r in range(3)), F.lit(0.0))) for c in range(3)]
    turn = lambda r, c: F.try_divide(at(r, c), size[c])
    yaw = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -turn(2, 0)))))
    return [yaw, F.degrees(F.atan2(turn(2, 1), turn(2, 2))), F.degrees(F.atan2(turn(1, 0), turn(0, 0))), at(0, 3), at(1, 3), at(2, 3)]
