"""Spectra of packed signals (rec, values): Fourier sums at given frequencies, and what is read off them in SQL."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsespark.settings import PULSE_BAND


def dft_power(signals: DataFrame, bins: list[int], n_fft: int, values: str = "values", key: str = "rec", hann: bool = False, centre: bool = True) -> DataFrame:
    """(rec, bin, power) at bins of an n_fft-point transform of each signal, by default with its mean removed; optionally
    under a (periodic) Hann window. Null samples count as 0; null and empty signals give no rows.

    One matrix product for all signals of a length in an Arrow batch; nothing is shuffled.
    """
    kind = dict(signals.dtypes)[key]

    def run(batches):
        for batch in batches:
            lengths: dict[int, list[int]] = {}
            arrays = batch.column("v").to_pylist()
            for k, v in enumerate(arrays):
                if v:
                    lengths.setdefault(len(v), []).append(k)
            for n, rows in lengths.items():
                x = np.nan_to_num(np.array([arrays[k] for k in rows], float))
                if centre:
                    x = x - x.mean(1, keepdims=True)
                if hann:
                    x = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n))
                turn = np.outer(np.arange(n), bins) * (2 * math.pi / n_fft)
                power = (x @ np.cos(turn)) ** 2 + (x @ np.sin(turn)) ** 2
                keys = batch.column(key).take(pa.array(np.repeat(rows, len(bins))))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(bins, len(rows)), pa.int64()), pa.array(power.reshape(-1))], names=[key, "bin", "power"])

    return signals.select(key, F.col(values).cast("array<double>").alias("v")).mapInArrow(run, f"`{key}` {kind}, bin long, power double")


def peak(power: DataFrame, fs: float, n_fft: int, key: str = "rec", band: tuple[float, float] = PULSE_BAND) -> DataFrame:
    """Per signal: rate of the strongest bin in the band (per minute; the lower one of equals), its share of the band's
    power (within 6 a minute), and the ratio to the rest in dB, the first harmonic's neighbourhood counted as signal."""
    p = power.withColumn("f", F.col("bin") * F.lit(fs / n_fft))
    inside = p.where(F.col("f").between(*band))
    top = inside.groupBy(key).agg(F.max_by("f", F.struct("power", -F.col("bin"))).alias("f0"))
    near = F.abs(F.col("f") - F.col("f0")) <= 0.1
    harmonic = near | (F.abs(F.col("f") - 2 * F.col("f0")) <= 0.1)
    in_band = F.col("f").between(*band)
    add = lambda c: F.sum(F.when(c, F.col("power")).otherwise(0.0))
    g = p.join(top, key).groupBy(key, "f0").agg(add(near & in_band).alias("near"), add(in_band).alias("band"), add(harmonic).alias("signal"), add(in_band & ~harmonic).alias("noise"))
    return g.select(key, (F.col("f0") * 60).alias("rate"), F.try_divide("near", "band").alias("peak_share"), (10 * F.log10(F.try_divide("signal", "noise"))).alias("snr_db"))


def prominent_peaks(power: DataFrame, share: float = 0.05, key: str = "rec") -> DataFrame:
    """power(rec, bin, power) -> its rows that are local maxima and stand out by `share` of the record's largest power or
    more: above the higher of the lowest powers between them and the next higher one on either side (or the end).

    Bins of a record are few and fixed, so peaks meet them by the record.
    """
    w = Window.partitionBy(key).orderBy("bin")
    p = power.withColumn("_a", F.lag("power").over(w)).withColumn("_b", F.lead("power").over(w)).withColumn("_most", F.max("power").over(Window.partitionBy(key)))
    top = p.where("power > _a AND power > _b").select(key, F.col("bin").alias("_k"), F.col("power").alias("_p"), "_most")
    both = top.join(power, key)
    higher = F.col("power") > F.col("_p")
    edges = both.groupBy(key, "_k", "_p", "_most").agg(F.max(F.when(higher & (F.col("bin") < F.col("_k")), F.col("bin"))).alias("_lo"), F.min(F.when(higher & (F.col("bin") > F.col("_k")), F.col("bin"))).alias("_hi"))
    near = edges.join(power, key)
    left = F.min(F.when((F.col("bin") <= F.col("_k")) & F.coalesce(F.col("bin") > F.col("_lo"), F.lit(True)), F.col("power")))
    right = F.min(F.when((F.col("bin") >= F.col("_k")) & F.coalesce(F.col("bin") < F.col("_hi"), F.lit(True)), F.col("power")))
    out = near.groupBy(key, "_k", "_p", "_most").agg(left.alias("_left"), right.alias("_right")).withColumn("prominence", F.col("_p") - F.greatest("_left", "_right"))
    return out.where(F.col("prominence") >= share * F.col("_most")).select(key, F.col("_k").alias("bin"), F.col("_p").alias("power"), "prominence")


def rate_beside_breathing(tapered: DataFrame, plain: DataFrame, breathing: DataFrame, fs: float, n_fft: int, apart: float = 3.0, candidates: int = 5, harmonics: int = 3, band: tuple[float, float] = PULSE_BAND, key: str = "rec") -> DataFrame:
    """(rec, rate, aware): the strongest of the `candidates` highest prominent peaks of `tapered` (rec, bin, power) that is
    not within `apart` a minute of the breathing rate (rec, breathing) or its next multiples; where none is left or the
    breathing rate is unknown, the strongest bin of `plain`."""
    step = 60.0 * fs / n_fft
    inside = lambda p: p.where((F.col("bin") * F.lit(fs / n_fft)).between(*band))
    usual = inside(plain).groupBy(key).agg((F.max_by("bin", F.struct("power", -F.col("bin"))) * step).alias("_usual"))
    peaks = prominent_peaks(inside(tapered), key=key)
    best = peaks.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("power"), F.desc("bin")))).where(F.col("_r") <= candidates)
    traps = breathing.where("breathing > 0 AND NOT isnan(breathing)").select(F.col(key).alias("_k"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda m: m * F.col("breathing"))).alias("_trap"))
    known = best.join(breathing.where("breathing > 0 AND NOT isnan(breathing)").select(key).distinct(), key, "left_semi")
    clear = known.join(traps, (F.col(key) == F.col("_k")) & (F.abs(F.col("bin") * step - F.col("_trap")) <= apart), "left_anti")
    first = clear.groupBy(key).agg((F.min_by("bin", "_r") * step).alias("_aware"))
    return usual.join(first, key, "left").select(key, F.col("_usual").alias("rate"), F.coalesce("_aware", "_usual").alias("aware"))
