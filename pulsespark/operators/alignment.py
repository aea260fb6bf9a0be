"""References brought to a recording's frames, and shifted and signed to match its pulse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsespark.operators import matching


def to_frames(reference: DataFrame, frames: DataFrame) -> DataFrame:
    """reference(rec, i, t, v) and frames(rec, frame, t) -> (rec, frame, v): the reference at each frame.

    By time where all samples and frames of a record have one; sample by sample where there are as many; otherwise it is
    stretched over the frames. Between samples straight lines, before and after them the nearest value. Both sides are put
    on one axis and sorted once; no pair of a sample and a frame is built. Numbers start at 0.
    """
    a = reference.groupBy("rec").agg(F.count(F.lit(1)).alias("_n"), F.count("t").alias("_nt"))
    b = frames.groupBy("rec").agg(F.count(F.lit(1)).alias("_m"), F.count("t").alias("_mt"))
    kind = F.when((F.col("_n") == F.col("_nt")) & (F.col("_m") == F.col("_mt")), "time").when(F.col("_n") == F.col("_m"), "same").otherwise("stretch")
    of = a.join(b, "rec").withColumn("_kind", kind)
    place = lambda i, n: F.when(F.col("_kind") == "time", F.col("t").cast("double")).when(F.col("_kind") == "same", F.col(i).cast("double")).otherwise(F.coalesce(F.try_divide(F.col(i).cast("double"), F.col(n) - 1), F.lit(0.0)))
    left = reference.join(of, "rec").select("rec", place("i", "_n").alias("_x"), F.col("v").cast("double").alias("v"), F.lit(None).cast("long").alias("frame"), F.lit(0).alias("_side"))
    right = frames.join(of, "rec").select("rec", place("frame", "_m").alias("_x"), F.lit(None).cast("double").alias("v"), F.col("frame").cast("long").alias("frame"), F.lit(1).alias("_side"))
    both = matching.fill_gaps(left.where("v IS NOT NULL").unionByName(right), "v", "_x", "_filled", "_side")
    return both.where("_side = 1").select("rec", "frame", F.col("_filled").alias("v"))


def sign_and_lag(pairs: DataFrame, lags: int, key: str = "rec") -> DataFrame:
    """pairs(rec, i, x, y): (rec, lag, sign) by which the reference x best matches y: delayed by lag samples (-lags to lags, the
    first of equals), and turned over where sign is -1."""
    shifted = pairs.select(key, "x", "i").join(pairs.select(key, "y", F.col("i").alias("_j")).withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("i", F.col("_j") - F.col("lag")), [key, "i"])
    c = shifted.groupBy(key, "lag").agg(F.corr("x", "y").alias("c"))
    best = F.max_by(F.struct("lag", "c"), F.struct(F.round(F.abs("c"), 9), -F.col("lag")))
    return c.groupBy(key).agg(best.alias("m")).select(key, F.col("m.lag").alias("lag"), F.when(F.col("m.c") < 0, -1).otherwise(1).alias("sign"))


def aligned(pairs: DataFrame, lags: int, key: str = "rec") -> DataFrame:
    """pairs(rec, i, x, y), i from 0 -> (rec, i, v, lag, sign): x shifted and signed to match y; what is shifted out at one end
    comes in at the other."""
    best = sign_and_lag(pairs, lags, key)
    n = F.max("i").over(Window.partitionBy(key)) + 1
    return pairs.select(key, "i", "x", n.alias("_n")).join(best, key).select(key, F.pmod(F.col("i") + F.col("lag"), F.col("_n")).alias("i"), (F.col("x") * F.col("sign")).alias("v"), "lag", "sign")
