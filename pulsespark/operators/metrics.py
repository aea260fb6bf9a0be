"""Evaluation reports: errors, confusion, agreement, ranks, roll-ups, rule grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over rows with both values; null where either is constant (built-in corr fails there)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def summarize(rows: DataFrame, pred: str, truth: str, *keys: str) -> DataFrame:
    """Per group over rows with both values: n, mae, its standard error, rmse, mape, pearson (null under 3 rows)."""
    e = F.col(pred) - F.col(truth)
    g = rows.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(*keys)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), (F.stddev_samp(F.abs(e)) / F.sqrt(F.count(F.lit(1)))).alias("mae_se"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(F.try_divide(e, F.col(truth)))) * 100).alias("mape"), correlation(pred, truth).alias("r"))
    return out.withColumn("pearson", F.when(F.col("n") >= 3, F.col("r"))).drop("r")


def confusion(rows: DataFrame, pred: str, truth: str, labels: list) -> DataFrame:
    """Dense counts (truth, pred, n) of all pairs of labels, those that never occur included."""
    dim = rows.sparkSession.createDataFrame([(x, y) for x in labels for y in labels], rows.select(truth, pred).schema)
    counts = rows.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(counts, [truth, pred], "left").select(truth, pred, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kappa(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """One row: n, accuracy and Cohen's kappa."""
    c = rows.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(pred, truth).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = c.select(F.explode(F.array(F.struct(F.lit("p").alias("s"), F.col(pred).alias("x"), F.col("n")), F.struct(F.lit("t").alias("s"), F.col(truth).alias("x"), F.col("n")))).alias("e")).groupBy("e.x").agg(F.sum(F.when(F.col("e.s") == "p", F.col("e.n")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("e.s") == "t", F.col("e.n")).otherwise(0.0)).alias("t"))
    pe = m.agg(F.sum(F.col("p") * F.col("t")).alias("pt"))
    po = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(pred) == F.col(truth), F.col("n")).otherwise(0.0)).alias("hit"))
    e, o = F.col("pt") / (F.col("n") * F.col("n")), F.col("hit") / F.col("n")
    return po.join(F.broadcast(pe)).select(F.col("n").cast("long").alias("n"), o.alias("accuracy"), F.try_divide(o - e, 1 - e).alias("kappa"))


#: Equal parts of a group's range of values, whose sums are carried on one after another.
PARTS = 4096


def _same(keys: tuple[str, ...]) -> Column:
    """Equality of keys with their copies named _k0, _k1, ...; null is equal to null."""
    out = F.lit(True)
    for k, name in enumerate(keys):
        out = out & F.col(name).eqNullSafe(F.col(f"_k{k}"))
    return out


def _copies(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(name).alias(f"_k{k}") for k, name in enumerate(keys)]


def sums_before(counts: DataFrame, value: str, amount: str, *keys: str) -> DataFrame:
    """counts (a row for each distinct value of a group) with `before`: the sum of amount over all smaller values.

    A group's range is cut into PARTS equal parts. Sums of whole parts are few rows a group; inside a part values are
    summed up beside those of other parts, so no task needs all values of a group.
    """
    ends = counts.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi")).select("_lo", "_hi", *_copies(keys))
    v = F.col(value).cast("double")
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
    c = counts.join(ends, _same(keys)).withColumn("_part", part).drop("_lo", "_hi", *(f"_k{k}" for k in range(len(keys))))
    whole = c.groupBy(*keys, "_part").agg(F.sum(amount).alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    under = whole.select(F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_under"), F.col("_part").alias("_p"), *_copies(keys))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = c.join(under, _same(keys) & (F.col("_part") == F.col("_p")))
    return out.withColumn("before", F.col("_under") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_under", "_part", "_p", *(f"_k{k}" for k in range(len(keys))))


def auc(rows: DataFrame, score: str, positive: Column, *keys: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties shared; null where one class is missing.

    Equal scores are counted first, and negatives below each score come from `sums_before`.
    """
    c = rows.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    c = sums_before(c, "_score", "q", *keys)
    g = c.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("before") + F.col("q") / 2.0)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return g.select(*keys, F.try_divide("u", F.col("p") * F.col("q").cast("double")).alias("auc"), "p", "q")


def quantiles(rows: DataFrame, value: str, points: list[float], *keys: str) -> DataFrame:
    """(keys, q): the exact points (0 to 1) of known values of each group, between two values in a straight line. Equal values
    are counted first, and a point is looked up where the counts before a value reach it, so no task holds a group."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("_total")).select("_total", *_copies(keys))
    c = sums_before(c, "_v", "n", *keys).join(total, _same(keys))
    place = lambda p: p * (F.col("_total") - 1)
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("_v").cast("double")))
    ends = [x for k, p in enumerate(points) for x in (at(F.floor(place(p))).alias(f"_a{k}"), at(F.ceil(place(p))).alias(f"_b{k}"))]
    g = c.groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    line = [F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (place(p) - F.floor(place(p))) for k, p in enumerate(points)]
    return g.select(*keys, F.array(*line).alias("q"))


def with_total(rows: DataFrame, key: str, *aggregates: Column, total: str = "all") -> DataFrame:
    """Aggregates per group and over all rows, by one rollup."""
    g = rows.rollup(key).agg(F.grouping(key).alias("_g"), *aggregates)
    return g.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_g")


def describe(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean, std, min, 10 / 50 / 90 % points and max per group."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(rows, value, [0.1, 0.5, 0.9], *keys).select("q", *_copies(keys))
    return g.join(q, _same(keys), "left").select(*keys, "count", "mean", "std", "min", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "max")


def detection(rows: DataFrame, hit: Column, truth: Column, *keys: str) -> DataFrame:
    """Pooled sensitivity, precision and F1 with guarded denominators, and false positives per 1000 negatives."""
    tp, fp, fn = F.count_if(hit & truth), F.count_if(hit & ~truth), F.count_if(~hit & truth)
    g = rows.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(~hit & ~truth).alias("tn"))
    one = F.lit(1)
    return g.withColumn("sensitivity", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).withColumn("f1", 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), one)).withColumn("fp_per_1000", 1000 * F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one))


def flag_report(df: DataFrame, ref: str, pred: str, limits: tuple[float, float]) -> DataFrame:
    """One row: segments, those scored (both rates known), their coverage, accuracy and kappa of the flags slow, normal and
    fast, and the mean absolute difference of the rates. Counts of pairs of flags are all that is gathered."""
    flag = lambda c: F.when(F.col(c) < limits[0], "slow").when(F.col(c) > limits[1], "fast").otherwise("normal")
    ok = F.col(ref).isNotNull() & F.col(pred).isNotNull()
    cells = df.groupBy(F.when(ok, flag(ref)).alias("a"), F.when(ok, flag(pred)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(ok, F.abs(F.col(pred) - F.col(ref)))).alias("e"))
    names = ("slow", "normal", "fast")
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col(c) == k, F.col("n"))), F.lit(0))
    g = cells.agg(F.sum("n").alias("segments"), F.coalesce(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))), F.lit(0)).alias("scored"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("_hit"), F.sum("e").alias("_e"), sum((of("a", k) * of("b", k) for k in names), F.lit(0)).alias("_chance"))
    n = F.nullif(F.col("scored"), F.lit(0)).cast("double")
    accuracy, chance = F.coalesce("_hit", F.lit(0)) / n, F.col("_chance") / (n * n)
    return g.select("segments", "scored", F.try_divide("scored", "segments").alias("coverage"), accuracy.alias("accuracy"), F.try_divide(accuracy - chance, 1 - chance).alias("kappa"), (F.col("_e") / n).alias("hr_mae"))


def error_report(rows: DataFrame, methods: list[str], ref: str, key: str, over: float = 10.0, irregular: str | None = None) -> DataFrame:
    """Per group and for "all": rows, share of irregular ones, and of each method the mean absolute error and the share of errors
    above `over`; unknown values are left out of a method's own figures. One rollup, combined before the shuffle."""
    error = lambda m: F.abs(F.col(m) - F.col(ref))
    own = [c for m in methods for c in (F.avg(error(m)).alias(f"{m}_mae"), F.avg(F.when(error(m).isNotNull(), (error(m) > over).cast("double"))).alias(f"{m}_over"))]
    share = [F.avg(F.col(irregular).cast("double")).alias("irregular_share")] if irregular else []
    return with_total(rows, key, F.count(F.lit(1)).alias("n"), *share, *own)


def variant_report(rows: DataFrame, variant: list[str], means: list[str], totals: list[str]) -> DataFrame:
    """Per variant: rows, means of some columns (unknown values left out) and totals of others."""
    return rows.groupBy(*variant).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in totals])
