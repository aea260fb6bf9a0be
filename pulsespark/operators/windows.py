"""Windows of a record as rows: beats or samples are grouped by (record, window), so a window is the unit of work and a
record of any length is spread over tasks. What a window needs then is one pass of numpy over padded Arrow batches.

Undefined values are null. A window that is not scored says why in `dropped`.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsespark.functions import kernels
from pulsespark.settings import CONTEXT, IBI_RANGE, MAX_SHARE, PREMATURITY, RECOVERY

FEATURES = ("nrmssd", "shannon_entropy", "sample_entropy", "sd1_sd2", "tpr")
LEAST_IBIS = 12
MAX_MISSING = 0.1
#: Cells of the largest temporary (pairs of intervals, or surroundings of each).
CELLS = 1 << 20
#: Values of the windows that are scored at once, padded to the longest of them (or one window).
VALUES = 1 << 15


# ---------------------------------------------------------------- intervals of many windows at once


def padded(values: list) -> np.ndarray:
    """Rows of unequal length as a matrix, NaN behind their ends."""
    out = np.full((len(values), max((len(v) for v in values), default=0)), np.nan)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _to_left(x: np.ndarray) -> np.ndarray:
    """Known values of each row in order, NaN behind them."""
    return np.take_along_axis(x, np.argsort(np.isnan(x), axis=1, kind="stable"), 1)


def _mean(x: np.ndarray) -> np.ndarray:
    n = (~np.isnan(x)).sum(1)
    return np.where(n > 0, np.nansum(x, 1) / np.maximum(n, 1), np.nan)


def _deviation(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_mean((x - _mean(x)[:, None]) ** 2))


def _divide(a: np.ndarray, b: np.ndarray, otherwise: float) -> np.ndarray:
    return np.where(b > 0, a / np.where(b > 0, b, 1), otherwise)


def _shannon(x: np.ndarray, n: np.ndarray, bins: int = 16, trim: int = 8, trim_above: int = 32) -> np.ndarray:
    s, rows = np.sort(x, 1), np.arange(len(x))
    lo = np.where(n > trim_above, trim, 0)
    hi = n - lo
    low, high = s[rows, np.minimum(lo, x.shape[1] - 1)], s[rows, np.clip(hi - 1, 0, x.shape[1] - 1)]
    at = np.arange(x.shape[1])
    inside = (at >= lo[:, None]) & (at < hi[:, None])
    spread = (high - low)[:, None]
    place = np.where(inside & (spread > 0), (s - low[:, None]) / np.where(spread > 0, spread, 1) * bins, 0)
    counts = np.zeros((len(x), bins))
    r, c = np.nonzero(inside)
    np.add.at(counts, (r, np.minimum(place[r, c].astype(int), bins - 1)), 1)
    p = counts / np.maximum(counts.sum(1), 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(1) / np.log2(bins)


def _sample_entropy(x: np.ndarray, n: np.ndarray, share: float = 0.2) -> np.ndarray:
    out = np.zeros(len(x))
    if x.shape[1] < 4:
        return out
    tolerance = share * _deviation(x)
    step = max(1, CELLS // x.shape[1] ** 2)
    block = max(1, CELLS // x.shape[1])  # templates at once of a window that has more pairs than cells
    for lo in range(0, len(x), step):
        y = x[lo : lo + step]
        known = ~np.isnan(y[:, 2:])  # the same templates for both lengths
        m2 = m3 = -known.sum(1)  # self-matches
        for at in range(0, known.shape[1], block):
            near = np.abs(y[:, at : at + block + 2, None] - y[:, None, :]) <= tolerance[lo : lo + step, None, None]
            two = near[:, :-2, :-2] & near[:, 1:-1, 1:-1]
            two &= known[:, at : at + block, None] & known[:, None, :]
            m2 = m2 + two.sum((1, 2))
            m3 = m3 + (two & near[:, 2:, 2:]).sum((1, 2))
        out[lo : lo + step] = np.where(m2 > 0, -np.log(np.maximum(m3, 1) / np.maximum(m2, 1)), 0.0)
    return np.where((n >= 4) & (tolerance > 0), out, 0.0) + 0.0


def rhythm_features(ibis: np.ndarray, least: int = LEAST_IBIS, limits: tuple[float, float] = IBI_RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(plausible intervals, features) of each row of a padded matrix; NaN features below `least` plausible intervals."""
    with np.errstate(invalid="ignore"):
        x = _to_left(np.where((ibis >= limits[0]) & (ibis <= limits[1]), ibis, np.nan))
        n = (~np.isnan(x)).sum(1)
        x = x[:, : max(int(n.max(initial=0)), 1)]
        if x.shape[1] < 3:
            return n, np.full((len(x), len(FEATURES)), np.nan)
        a, b = x[:, :-1], x[:, 1:]
        turn = ((b[:, :-1] > a[:, :-1]) & (b[:, :-1] > b[:, 1:])) | ((b[:, :-1] < a[:, :-1]) & (b[:, :-1] < b[:, 1:]))
        values = [
            _divide(np.sqrt(_mean((b - a) ** 2)), _mean(x), np.nan),
            _shannon(x, n),
            _sample_entropy(x, n),
            _divide(_deviation((b - a) / np.sqrt(2)), _deviation((b + a) / np.sqrt(2)), 0.0),
            turn.sum(1) / np.maximum(n - 2, 1),
        ]
        return n, np.where((n >= least)[:, None], np.stack(values, 1), np.nan)


def _middle(x: np.ndarray, least: int) -> np.ndarray:
    """Median of the known values along the last axis; NaN where fewer than `least` are."""
    s, n = np.sort(x, -1), (~np.isnan(x)).sum(-1)  # NaN comes last
    at = lambda k: np.take_along_axis(s, k[..., None], -1)[..., 0]
    return np.where(n >= least, (at(np.maximum(n - 1, 0) // 2) + at(np.minimum(n // 2, x.shape[-1] - 1))) / 2, np.nan)


def extra_of(ibis: np.ndarray, prematurity: float = PREMATURITY, recovery: float = RECOVERY, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """(extra, median) over beats 1 .. of each row of intervals: whether the beat that ends an interval comes early and is
    followed by a pause, and the median of up to `context` intervals on either side of the two beside it."""
    n = ibis.shape[1]
    if n < 2:
        return np.zeros(ibis.shape, bool), np.full(ibis.shape, np.nan)
    wide = np.pad(ibis, ((0, 0), (context, context)), constant_values=np.nan)
    around = np.lib.stride_tricks.sliding_window_view(wide, 2 * context + 2, axis=1)
    beside = np.delete(np.arange(2 * context + 2), [context, context + 1])
    median = np.full((len(ibis), n - 1), np.nan)
    block = max(1, CELLS // (2 * context * max(len(ibis), 1)))
    for at in range(0, n - 1, block):
        median[:, at : at + block] = _middle(around[:, at : at + block, beside], 3)
    with np.errstate(invalid="ignore"):
        beats = (~np.isnan(ibis)).sum(1) + 1
        hit = (ibis[:, :-1] < (1 - prematurity) * median) & (ibis[:, 1:] > recovery * median) & (beats >= 5)[:, None]
    pad = lambda x, v: np.pad(x, ((0, 0), (0, 1)), constant_values=v)
    return pad(hit, False), pad(median, np.nan)


def without_extra(ibis: np.ndarray, cap: float = MAX_SHARE, tolerance: float | None = None, found: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intervals left, extra beats, removed) of each row: both intervals beside an extra beat go, unless more than `cap` of
    the beats are extra. With a tolerance only extra beats go whose next intervals but one are that near to the median,
    and the others are not counted."""
    hit, median = extra_of(ibis) if found is None else found
    n = hit.sum(1)
    few = (n > 0) & (n <= cap * ((~np.isnan(ibis)).sum(1) + 1))
    gone = hit & few[:, None]
    if tolerance is not None:
        pad = np.pad(ibis, ((0, 0), (1, 2)), constant_values=np.nan)
        with np.errstate(invalid="ignore"):
            far = lambda x: np.abs(x / median - 1) > tolerance  # noqa: E731  unknown neighbours are not far
            gone &= ~(far(pad[:, : ibis.shape[1]]) | far(pad[:, 3 : 3 + ibis.shape[1]]))
        n = np.where(few, gone.sum(1), n)
    removed = gone.any(1)
    beside = gone.copy()
    beside[:, 1:] |= gone[:, :-1]
    return _to_left(np.where(beside, np.nan, ibis)), n, removed


# ---------------------------------------------------------------- windows as rows


def beat_windows(beats: DataFrame, width: float, *kept: Column, t: Column | str = "t", tie: str = "beat", key: str = "rec") -> DataFrame:
    """(rec, win, beats, kept...): the beats of each window [win * width, (win + 1) * width) in time order, and aggregates.

    Only windows that end before the record's last beat. Rows without a time are in no window.
    """
    time = F.col(t) if isinstance(t, str) else t
    g = beats.where(time.isNotNull()).groupBy(key, F.floor(time / width).alias("win")).agg(F.array_sort(F.collect_list(F.struct(time.cast("double").alias("t"), tie))).alias("b"), F.max(time).alias("last"), *kept)
    g = g.withColumn("last", F.max("last").over(Window.partitionBy(key)))
    return g.where((F.col("win") + 1) * width < F.col("last")).withColumn("beats", F.col("b.t")).drop("b", "last")


def parts(batch: pa.RecordBatch, column: str):
    """(rows, arrays): runs of a batch's rows whose arrays, padded to the longest, have VALUES values at most (or one row), so
    what a task holds beside its Arrow batch doesn't grow with the rows or with what they hold."""
    size = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, most = 0, 4096
    while at < batch.num_rows:
        cells = np.maximum.accumulate(size[at : at + most]) * np.arange(1, len(size[at : at + most]) + 1)
        n = max(int(np.searchsorted(cells, VALUES, side="right")), 1)
        rows = batch.slice(at, n)
        yield rows, [np.asarray([] if v is None else v, float) for v in rows.column(column).to_pylist()]
        at += n


def _map(windows: DataFrame, column: str, out: list[tuple[str, str]], f) -> DataFrame:
    """windows without `column`, with the columns that f gives for a list of its arrays."""
    rest = [c for c in windows.columns if c != column]
    schema = T.StructType([*(windows.schema[c] for c in rest), *T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in out)).fields])

    def run(batches):
        for part, values in (x for batch in batches for x in parts(batch, column)):
            made = f(values)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(_column(v, k) for v, (_, k) in zip(made, out, strict=True))], names=[*rest, *(n for n, _ in out)])

    return windows.mapInArrow(run, schema)


def _column(values, kind: str) -> pa.Array:
    if kind == "double":
        return pa.array(np.asarray(values, float), pa.float64(), mask=np.isnan(np.asarray(values, float)))
    return pa.array(values, {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[kind])


def window_rows(windows: DataFrame, least: int = LEAST_IBIS, cap: float | None = None, tolerance: float | None = None) -> DataFrame:
    """windows(rec, win, beats, ...) as `beat_windows` gives them, with n_beats, hr_bpm (of all intervals), n_extra,
    extra_removed, n_ibis (plausible ones), the five rhythm features and `dropped`.

    With a cap, extra beats are removed before the features. `dropped` is "few beats" below `least` plausible intervals,
    else null; such windows have null features.
    """

    def score(values):
        ibis = padded([np.diff(v) for v in values])
        n_beats = [len(v) for v in values]
        with np.errstate(invalid="ignore"):
            hr = 60 / np.where(_mean(ibis) > 0, _mean(ibis), np.nan) if len(values) else np.zeros(0)
        left, n_extra, removed = (ibis, np.zeros(len(values), int), np.zeros(len(values), bool)) if cap is None else without_extra(ibis, cap, tolerance)
        n, features = rhythm_features(left, least)
        return [n_beats, hr, n_extra, removed, n, *features.T, [None if k >= least else "few beats" for k in n]]

    out = [("n_beats", "long"), ("hr_bpm", "double"), ("n_extra", "long"), ("extra_removed", "boolean"), ("n_ibis", "long"), *((f, "double") for f in FEATURES), ("dropped", "string")]
    return _map(windows, "beats", out, score)


def removal_rows(windows: DataFrame, settings: dict[str, tuple[float, float | None]], least: int = LEAST_IBIS) -> DataFrame:
    """A row for each window and setting (and "none"): n_extra, removed, n_ibis and the features under it.

    windows as in `window_rows`. Beats and extra beats of a window are found once and scored under all settings; a setting
    that leaves fewer than `least` intervals keeps the features without removal. Windows below `least` without removal
    are left out.
    """
    named = [("none", (0.0, None)), *settings.items()]

    def score(values):
        ibis = padded([np.diff(v) for v in values])
        found = extra_of(ibis)
        n0, base = rhythm_features(ibis, least)
        parts = []
        for name, (cap, tolerance) in named:
            left, n_extra, removed = without_extra(ibis, cap, tolerance, found)
            n, f = rhythm_features(left, least)
            few = n < least
            parts.append(([name] * len(values), n_extra, removed, np.where(few, n0, n), np.where(few[:, None], base, f)))
        return [[[p[k][i] for p in parts] for i in range(len(values))] for k in range(5)]

    rest = [c for c in windows.columns if c != "beats"]
    schema = T.StructType([*(windows.schema[c] for c in rest), *T.StructType.fromDDL("setting string, n_extra long, removed boolean, n_ibis long, " + ", ".join(f"{f} double" for f in FEATURES)).fields])

    def run(batches):
        k = len(named)
        for part, values in (x for batch in batches for x in parts(batch, "beats")):
            setting, n_extra, removed, n, f = score(values)
            flat = lambda x: [z for y in x for z in y]
            at = pa.array(np.repeat(np.arange(part.num_rows), k))
            features = np.array(flat(f)).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in rest), pa.array(flat(setting), pa.string()), pa.array(flat(n_extra), pa.int64()), pa.array([bool(x) for x in flat(removed)]), pa.array(flat(n), pa.int64()), *(_column(v, "double") for v in features.T)], names=schema.names)

    return windows.mapInArrow(run, schema).where(F.col("nrmssd").isNotNull())


def flagged_shares(windows: DataFrame, least: int = 12) -> DataFrame:
    """windows of at least `least` beats, with beats (their number) and flagged_share, the share that are extra."""

    def score(values):
        n = np.array([len(v) for v in values])
        hits = extra_of(padded([np.diff(v) for v in values]))[0].sum(1) if len(values) else n
        return [n, hits / np.maximum(n, 1)]

    return _map(windows.where(F.size("beats") >= least).withColumnRenamed("beats", "_t"), "_t", [("beats", "long"), ("flagged_share", "double")], score)


def signal_windows(samples: DataFrame, fs: float, seconds: float, max_missing: float = MAX_MISSING, least: int = LEAST_IBIS, camera_fs: float | None = None, key: str = "rec", i: str = "i", v: str = "v") -> DataFrame:
    """samples(rec, i, v) -> a row for each whole window: rec, win, start_s, missing, n_beats, hr_bpm, beat_shape,
    peak_share, n_ibis, the five features, beats and `dropped`.

    A window with more than max_missing unknown samples ("missing") or without variance ("flat") is not analysed, one
    with too few plausible intervals has no features ("few beats"). Gaps are filled by straight lines, the window is
    resampled to camera_fs if given, detrended, band-passed, and its beats found.
    """
    from fractions import Fraction

    n = int(round(seconds * fs))
    ratio = Fraction(camera_fs / fs).limit_denominator(1000) if camera_fs else None
    value = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    g = samples.groupBy(key, F.floor(F.col(i) / n).alias("win")).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.coalesce(value, F.lit(float("nan"))).alias("v")))).alias("s"))
    w = g.where(F.size("s") == n).select(key, "win", (F.col("win") * n / fs).alias("start_s"), F.col("s.v").alias("values"))

    def score(values):
        x = np.array(values).reshape(len(values), n)
        missing, why = np.isnan(x).mean(1), np.full(len(x), None, object)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            flat = ~(np.nanstd(x, axis=1) > 0)
        why[flat] = "flat"
        why[missing > max_missing] = "missing"
        good = np.flatnonzero(np.equal(why, None))
        at = np.arange(n)
        y = np.array([np.interp(at, at[~np.isnan(r)], r[~np.isnan(r)]) for r in x[good]]).reshape(len(good), n)
        f = fs
        if ratio and len(good):
            y, f = kernels.resample(y, ratio.numerator, ratio.denominator), camera_fs
        y = kernels.clean_pulse(y, f) if len(good) else y
        beats = [kernels.detect_beats(r, f) for r in y]
        found = [np.zeros(0)] * len(x)
        shape, share = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for k, r, b in zip(good, y, beats, strict=True):
            found[k], shape[k], share[k] = b, kernels.beat_shape(r, f, b), kernels.peak_share(r, f)
        ibis = padded([np.diff(b) for b in found])
        m, features = rhythm_features(ibis, least) if len(x) else (np.zeros(0, int), np.zeros((0, len(FEATURES))))
        with np.errstate(invalid="ignore"):
            hr = 60 / np.where(_mean(ibis) > 0, _mean(ibis), np.nan)
        why[np.equal(why, None) & (m < least)] = "few beats"
        return [missing, [len(b) for b in found], hr, shape, share, m, *features.T, [b.tolist() for b in found], why.tolist()]

    out = [("missing", "double"), ("n_beats", "long"), ("hr_bpm", "double"), ("beat_shape", "double"), ("peak_share", "double"), ("n_ibis", "long"), *((f, "double") for f in FEATURES), ("beats", "array<double>"), ("dropped", "string")]
    return _map(w, "values", out, score)
