"""Packed signals (rec, values) through the kernels, an Arrow batch at a time, and windows of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsespark.functions import kernels


def pack(samples: DataFrame, key: str = "rec", i: str = "i", value: str = "v") -> DataFrame:
    """(rec, values): the samples of each record in order. One record must fit in a task."""
    return samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(i, value))).alias("s")).select(key, F.col(f"s.{value}").alias("values"))


def unpack(signals: DataFrame, key: str = "rec") -> DataFrame:
    return signals.select(key, F.posexplode("values").alias("i", "v"))


def _rows(values: pd.Series, f) -> pd.Series:
    """f over all signals of equal length at once; null and empty signals give null."""
    out: list = [None] * len(values)
    lengths: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None and len(v):
            lengths.setdefault(len(v), []).append(i)
    for own in lengths.values():
        x = np.nan_to_num(np.array([np.asarray(values.iloc[i], float) for i in own]))
        for i, row in zip(own, f(x), strict=True):
            out[i] = row
    return pd.Series(out)


def filtered(signals: DataFrame, fs: float, column: str = "values", out: str = "pulse") -> DataFrame:
    """signals with `out`: detrended, band-passed, unit deviation."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return _rows(v, lambda x: kernels.clean_pulse(x, fs))

    return signals.withColumn(out, run(column))


def beats(signals: DataFrame, fs: float, column: str = "pulse") -> DataFrame:
    """signals with `beats` (times), `rate` (a minute, by spectrum) and `shape` (consistency of beats, 0 to 1)."""

    @F.pandas_udf("struct<beats:array<double>,rate:double,shape:double>")
    def run(v: pd.Series) -> pd.DataFrame:
        out = []
        for x in v:
            x = np.nan_to_num(np.asarray(x if x is not None else [], float))
            b = kernels.detect_beats(x, fs)
            out.append((b.tolist(), float(kernels.peak_rate(x, fs)[0]) if len(x) > 2 else None, kernels.beat_shape(x, fs, b)))
        return pd.DataFrame(out, columns=["beats", "rate", "shape"])

    return signals.withColumn("_b", run(column)).select("*", "_b.beats", "_b.rate", "_b.shape").drop("_b")


def colour_pulse(colours: DataFrame, fs: float, method: str = "pos", key: str = "rec") -> DataFrame:
    """colours(rec, r, g, b: arrays) -> (rec, values): the pulse by `pos`, `chrom` or `green`."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x in zip(r, g, b, strict=True):
            rgb = np.stack([np.asarray(c, float) for c in x], axis=1)
            green = -(rgb[:, 1] / (rgb[:, 1].mean() or 1) - 1)
            out.append((green if method == "green" else getattr(kernels, method)(rgb, fs)).tolist())
        return pd.Series(out)

    return colours.select(key, run("r", "g", "b").alias("values"))
