"""Joins in time: nearest match, windows, fill-forward, gaps, lags. Buckets turn ranges into equi-joins, so none is a
cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsespark.operators.metrics import correlation


def nearest(left: DataFrame, right: DataFrame, t: str = "t", key: str = "rec") -> DataFrame:
    """left with `match`, the time of the nearest row of right in the same record (a tie takes the earlier one).

    An as-of join in both directions by one sort: both sides are unioned and the last time seen is carried on, so no
    pair is built.
    """
    row = left.select(key, t, F.struct(*left.columns).alias("row"))
    none = F.lit(None)
    both = row.select(key, t, "row", none.cast(left.schema[t].dataType).alias("u"), F.lit(1).alias("side")).unionByName(right.select(key, t, none.cast(row.schema["row"].dataType).alias("row"), F.col(t).alias("u"), F.lit(0).alias("side")))
    w = Window.partitionBy(key)
    back = F.last("u", True).over(w.orderBy(t, "side").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("u", True).over(w.orderBy(t, F.col("side").desc()).rowsBetween(0, Window.unboundedFollowing))
    m = both.withColumn("back", back).withColumn("ahead", ahead).where("side = 1")
    pick = F.when(F.col("ahead").isNull() | (F.col(t) - F.col("back") <= F.col("ahead") - F.col(t)), F.col("back")).otherwise(F.col("ahead"))
    return m.select("row.*", pick.alias("match"))


def in_windows(points: DataFrame, windows: DataFrame, width, t: str = "t", start: str = "start", key: str = "rec") -> DataFrame:
    """Pairs of a window [start, start + width) and the points inside it, by two buckets of one width each."""
    w = windows.withColumn("_b", F.explode(F.array(F.floor(F.col(start) / width), F.floor(F.col(start) / width) + 1)))
    p = points.withColumn("_b", F.floor(F.col(t) / width))
    return w.join(p, [key, "_b"]).where((F.col(t) >= F.col(start)) & (F.col(t) < F.col(start) + width)).drop("_b")


def fill_forward(rows: DataFrame, state: str, out: str, order: list[str], key: str = "rec") -> DataFrame:
    """rows with `out`: the last non-null `state` up to and including the row."""
    return rows.withColumn(out, F.last(state, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def fill_gaps(rows: DataFrame, value: str, t: str, out: str, tie: str, key: str = "rec") -> DataFrame:
    """rows with `out`: value, or the straight line between its neighbours in time; the nearest value at both ends."""
    w = Window.partitionBy(key).orderBy(t, tie)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    r = rows.withColumn("_a", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * ((F.col(t) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t")))
    return r.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)).drop("_a", "_b")


def best_lag(pairs: DataFrame, lags: int, key: str = "rec") -> DataFrame:
    """pairs(rec, i, x, y): the shift of y, -lags to lags, of the largest absolute correlation with x; the first wins."""
    shifted = pairs.select(key, "x", "i").join(pairs.select(key, F.col("y"), F.col("i").alias("j")).withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("i", F.col("j") - F.col("lag")), [key, "i"])
    c = shifted.groupBy(key, "lag").agg(correlation("x", "y").alias("c"))
    return c.groupBy(key).agg(F.max_by("lag", F.struct(F.round(F.abs("c"), 9), -F.col("lag"))).alias("lag"))
