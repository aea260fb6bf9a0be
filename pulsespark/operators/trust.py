"""Trust in sensors (patches): weights from geometry and brightness, leave-one-out consistency, fusion, confidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsespark.operators.metrics import correlation
from pulsespark.settings import BRIGHT, DARK, FACING_MIN, LUMA


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def facing_weight(facing: Column, least: float = FACING_MIN) -> Column:
    """facing, 0 where it is unknown or below the least."""
    f = F.coalesce(facing, F.lit(0.0))
    return F.when(f < least, 0.0).otherwise(f)


def _ramp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def brightness_weight(y: Column, dark: tuple[float, float] = DARK, bright: tuple[float, float] = BRIGHT) -> Column:
    """1 between dark and bright, falling to 0 beyond both; 0 where it is unknown."""
    return F.coalesce(_ramp(y, *dark) * (1 - _ramp(y, *bright)), F.lit(0.0))


def consistency(samples: DataFrame, value: str = "v", weight: Column | None = None) -> DataFrame:
    """samples(rec, patch, i, v) -> (rec, patch, consistency): correlation of each patch with the weighted sum of all
    others of its record, 0 to 1; 1 for a lone patch, 0 where either is constant."""
    w = F.lit(1.0) if weight is None else weight
    at = Window.partitionBy("rec", "i")
    s = samples.withColumn("_wv", w * F.col(value)).withColumn("_rest", F.sum("_wv").over(at) - F.col("_wv")).withColumn("_n", F.count(F.lit(1)).over(at))
    g = s.groupBy("rec", "patch").agg(correlation(value, "_rest").alias("c"), F.max("_n").alias("n"))
    c = F.coalesce("c", F.lit(0.0))
    return g.select("rec", "patch", F.when(F.col("n") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).alias("consistency"))


def fuse(samples: DataFrame, weights: DataFrame, value: str = "v") -> DataFrame:
    """(rec, i, fused): patches summed by normalised weights (rec, patch, weight); equal weights where all are 0."""
    w = Window.partitionBy("rec")
    n = weights.withColumn("_s", F.sum("weight").over(w)).withColumn("_k", F.count(F.lit(1)).over(w))
    n = n.select("rec", "patch", F.when(F.col("_s") > 0, F.col("weight") / F.col("_s")).otherwise(1 / F.col("_k")).alias("weight"))
    return samples.join(n, ["rec", "patch"]).groupBy("rec", "i").agg(F.sum(F.col("weight") * F.col(value)).alias("fused"))


def effective_patches(weights: DataFrame) -> DataFrame:
    """(rec, n_eff, coverage): 1 / sum of squared normalised weights, and its share of 0.3 of the patches, 1 at most."""
    w = Window.partitionBy("rec")
    s = weights.withColumn("_p", F.try_divide("weight", F.sum("weight").over(w)))
    g = s.groupBy("rec").agg(F.try_divide(F.lit(1.0), F.sum(F.col("_p") * F.col("_p"))).alias("n_eff"), F.count(F.lit(1)).alias("n"))
    return g.select("rec", "n_eff", F.least(F.lit(1.0), F.col("n_eff") / F.greatest(F.lit(1.0), 0.3 * F.col("n"))).alias("coverage"))


def agreement(weights: DataFrame) -> DataFrame:
    """(rec, agreement): mean of the patches' consistency by weight; 1 for a lone patch, null where all weights are 0."""
    g = weights.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("weight") * F.col("consistency")), F.sum("weight")).alias("a"))
    return g.select("rec", F.when(F.col("n") < 2, 1.0).otherwise(F.col("a")).alias("agreement"))


def choose_level(counts: DataFrame, levels: dict[int, list[list[int]]], least: float, key: str = "rec", frame: str = "frame", patch: str = "patch", n: str = "n") -> DataFrame:
    """(key, level): the finest level whose typical group of patches has at least `least` pixels; the coarsest if none.

    levels: number of groups -> the patches of each group, few and fixed. The typical size is the median over frames of
    the median over groups; groups without pixels count as 0 in a frame, and frames without any pixel are left out.
    """
    order = sorted(levels, reverse=True)

    def middle(sums: Column, k: int) -> Column:
        s = F.array_sort(sums)
        return (s[(k - 1) // 2] + s[k // 2]) / 2.0

    sums = {x: F.array(*[F.coalesce(F.sum(F.when(F.col(patch).isin(g), F.col(n))), F.lit(0)).cast("double") for g in levels[x]]) for x in order}
    f = counts.groupBy(key, frame).agg(F.max(n).alias("_most"), *[sums[x].alias(f"_s{x}") for x in order]).where("_most > 0")
    g = f.select(key, *[middle(F.col(f"_s{x}"), len(levels[x])).alias(f"_m{x}") for x in order]).groupBy(key).agg(*[F.median(f"_m{x}").alias(f"_m{x}") for x in order])
    return g.select(key, F.coalesce(*[F.when(F.col(f"_m{x}") >= least, x) for x in order], F.lit(order[-1])).alias("level"))


def geometric_mean(*parts: Column) -> Column:
    """Geometric mean of parts, each clipped to 0 .. 1."""
    product = F.lit(1.0)
    for p in parts:
        product = product * F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.pow(product, F.lit(1.0 / len(parts)))


def merge_weighted(rows: DataFrame, weight: str, values: list[str], *keys: str) -> DataFrame:
    """Weighted means per group; rows with a null value weigh nothing; null where all weights are 0."""
    return rows.groupBy(*keys).agg(F.sum(weight).alias("weight"), *[F.try_divide(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * F.col(weight))), F.nullif(F.sum(F.when(F.col(v).isNotNull(), F.col(weight))), F.lit(0.0))).alias(v) for v in values])


def overlap_add(segments: DataFrame, length: int, value: str = "values", key: str = "rec", start: str = "start") -> DataFrame:
    """(rec, i, v): half-overlapping segments summed under a Hann window (without its zero ends), divided by its sum."""
    s = segments.select(key, start, F.posexplode(value).alias("k", "x"))
    h = 0.5 - 0.5 * F.cos(F.lit(2 * math.pi / (length + 1)) * (F.col("k") + 1))
    return s.withColumn("h", h).groupBy(key, (F.col(start) + F.col("k")).alias("i")).agg((F.sum(F.col("x") * F.col("h")) / F.greatest(F.sum("h"), F.lit(1e-9))).alias("v"))


def moving_rms(rows: DataFrame, value: str, order: list[str], half: int, key: str = "rec") -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-half, half - 1)
    return rows.withColumn("rms", F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)))


def gradient(rows: DataFrame, value: str, order: list[str], key: str = "rec") -> DataFrame:
    """Central differences per step, one-sided at both ends."""
    w = Window.partitionBy(key).orderBy(*order)
    a, b, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return rows.withColumn("gradient", F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2.0))
