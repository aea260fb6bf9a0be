"""Grids, orders and roll-ups of reports: all DataFrame expressions, one shuffle on the record or group each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Grid points of a pause that are made from one row.
PAUSE = 4096


def resample(df: DataFrame, step: int, t: str = "us", x: str = "v", key: str = "rec", order: str = "beat") -> DataFrame:
    """(key, g, value): x at g = first t, first t + step, ... before the last t of each key, by straight lines.

    A grid point is null where its nearest sample is (of two equally near ones, the later); else it lies on the line between
    the nearest samples with a value on either side, or has the value of the only side. Each pair of neighbours gives the
    points between them, so no grid is joined; a long pause is cut into stretches of PAUSE points first, so none is one
    large row. Keys with one sample have none, keys with fewer than two known samples have nulls; rows with a null t are
    left out.
    """
    w = Window.partitionBy(key).orderBy(t, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    s = df.where(F.col(t).isNotNull()).select(
        key, F.col(t).alias("t"), F.col(x).isNotNull().alias("here"), F.min(t).over(Window.partitionBy(key)).alias("t0"), F.lead(t).over(w).alias("next"),
        F.lead(F.col(x).isNotNull()).over(w).alias("there"), F.last(known, ignorenulls=True).over(before).alias("a"), F.first(known, ignorenulls=True).over(after).alias("b"), F.count(x).over(Window.partitionBy(key)).alias("n"))
    low, high = F.ceil((F.col("t") - F.col("t0")) / step), F.ceil((F.col("next") - F.col("t0")) / step) - 1
    g = s.where("next > t").withColumn("low", low.cast("long")).withColumn("high", high.cast("long")).where("low <= high")
    g = g.withColumn("from", F.explode(F.sequence(F.col("low"), F.col("high"), F.lit(PAUSE).cast("long"))))
    g = g.withColumn("g", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PAUSE - 1, F.col("high"))))).withColumn("g", F.col("g") * step + F.col("t0"))
    line = F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("g") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    near = F.when(F.col("g") - F.col("t") < F.col("next") - F.col("g"), F.col("here")).otherwise(F.when(F.col("g") == F.col("t"), F.col("here")).otherwise(F.col("there")))
    return g.select(key, "g", F.when(near & (F.col("n") >= 2), F.coalesce(line, F.col("a.x"), F.col("b.x"))).alias("value"))


def natural_key(name: Column) -> Column:
    """A sortable key in which runs of digits count as numbers: rec2 before rec10."""
    pattern = F.lit(r"(\D*)(\d+|$)")
    number = F.transform(F.regexp_extract_all(name, pattern, F.lit(2)), lambda n: F.when(n == "", F.lit(-1)).otherwise(n.cast("long")))
    return F.transform(F.arrays_zip(F.regexp_extract_all(name, pattern, F.lit(1)).alias("text"), number.alias("number")), lambda p: F.struct(p["text"], p["number"]))


def head_by(df: DataFrame, n: int, *order: Column, by: list[str]) -> DataFrame:
    """The first n rows of each group in an order; ranks are cut before the rows leave their group's sort."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in `order`, by a combinable minimum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def scores_by_record(df: DataFrame, hit: Column, truth: Column, kinds: dict[str, Column], key: str = "rec") -> DataFrame:
    """Per record: beats, premature, tp, fp, fn, and for each kind of beat its hits and number; rows scored only."""
    own = [c for name, is_kind in kinds.items() for c in (F.count_if(hit & is_kind).alias(f"tp_{name}"), F.count_if(is_kind).alias(f"n_{name}"))]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("beats"), F.count_if(truth).alias("premature"), F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"), *own)


def removal_name(cap: float, tolerance: float | None) -> str:
    """Name of a removal setting, without trailing noughts."""
    return f"cap{cap:g}" + ("" if tolerance is None else f"_tol{tolerance:g}")


def window_group(af: Column, premature: Column) -> Column:
    return F.when(af, "AF").when(premature, "non-AF with extra beats").otherwise("non-AF without")


def removal_table(df: DataFrame, settings: list[str], group: Column) -> DataFrame:
    """Per group of windows: their number, and the share called positive (at least 0.5) under each setting."""
    return df.groupBy(group.alias("kind")).agg(F.count(F.lit(1)).alias("windows"), *[F.avg((F.col(s) >= 0.5).cast("double")).alias(s) for s in settings])


def choose_removal(shares: DataFrame, settings: list[str], base: str, loss: float) -> DataFrame:
    """(choice): the setting with the fewest false alarms on windows with extra beats among those that lose `loss` of the
    AF share of `base` at most; ties go to the greater AF share, and "none" if no setting keeps it."""
    wide = shares.select("kind", F.explode(F.create_map(*[x for s in [base, *settings] for x in (F.lit(s), F.col(s))])).alias("setting", "share"))
    cast = wide.groupBy("setting").agg(F.max(F.when(F.col("kind") == "AF", F.col("share"))).alias("af"), F.max(F.when(F.col("kind") == "non-AF with extra beats", F.col("share"))).alias("false"))
    least = cast.where(F.col("setting") == base).select((F.col("af") - loss).alias("least"))
    fit = cast.where(F.col("setting") != base).crossJoin(F.broadcast(least)).where("af >= least")  # one row of each setting
    return fit.agg(F.coalesce(F.min_by("setting", F.struct("false", -F.col("af"), "setting")), F.lit("none")).alias("choice"))


def subject_rates(df: DataFrame, truth: str, score: str, subject: str = "rec") -> DataFrame:
    """(subjects, sensitivity, specificity) of mean scores per subject, whose truth is that of any of its rows."""
    s = df.groupBy(subject).agg(F.max(truth).alias("y"), F.avg(score).alias("p"))
    return s.agg(F.count(F.lit(1)).alias("subjects"), (F.count_if(F.col("y") & (F.col("p") >= 0.5)) / F.greatest(F.count_if("y"), F.lit(1))).alias("sensitivity"), (F.count_if(~F.col("y") & (F.col("p") < 0.5)) / F.greatest(F.count_if(~F.col("y")), F.lit(1))).alias("specificity"))
