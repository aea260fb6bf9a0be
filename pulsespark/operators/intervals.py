"""Beats, inter-beat intervals and what is computed from them, in Catalyst expressions.

Beats are rows (rec, t) with an optional tie-breaking column; every function takes and returns DataFrames. All windows
run inside one record and are bounded by its length; undefined results are null, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsespark.settings import CONTEXT, IBI_RANGE, MAX_SHARE, PREMATURITY, RECOVERY


def by_time(*order: str):
    return Window.partitionBy("rec").orderBy(*order)


def intervals(beats: DataFrame, t: str = "t", unit: float = 1.0, tie: str = "beat") -> DataFrame:
    """beats with `ibi`, the time since the beat before in units; null at a record's first beat."""
    return beats.withColumn("ibi", (F.col(t) - F.lag(t).over(by_time(t, tie))) / F.lit(unit))


def clean(ibis: DataFrame, limits: tuple[float, float] = IBI_RANGE) -> DataFrame:
    """Only plausible intervals (limits included); later differences bridge what is removed."""
    return ibis.where(F.col("ibi").between(*limits))


def neighbours(ibis: DataFrame, t: str = "t", tie: str = "beat") -> DataFrame:
    """ibis with the intervals before and after (`prev`, `next`)."""
    w = by_time(t, tie)
    return ibis.withColumn("prev", F.lag("ibi").over(w)).withColumn("next", F.lead("ibi").over(w))


def variability(ibis: DataFrame, t: str = "t", tie: str = "beat") -> DataFrame:
    """Per record: n, mean interval, RMSSD and SDNN (times 1000; null under 3 intervals), RMSSD over the mean."""
    d = neighbours(ibis, t, tie).withColumn("d2", F.pow(F.col("ibi") - F.col("prev"), 2))
    g = d.groupBy("rec").agg(F.count("ibi").alias("n"), F.avg("ibi").alias("mean"), F.sqrt(F.avg("d2")).alias("r"), F.stddev_samp("ibi").alias("s"))
    enough = F.col("n") >= 3
    return g.select("rec", "n", "mean", F.when(enough, F.col("r") * 1000).alias("rmssd"), F.when(enough, F.col("s") * 1000).alias("sdnn"), F.try_divide("r", "mean").alias("nrmssd"))


def poincare(ibis: DataFrame, t: str = "t", tie: str = "beat") -> DataFrame:
    """Per record: ratio of the two axes of the (interval, next interval) cloud, 0 if the long one is 0; share of strict
    turning points."""
    d = neighbours(ibis, t, tie)
    up = (F.col("ibi") > F.col("prev")) & (F.col("ibi") > F.col("next"))
    down = (F.col("ibi") < F.col("prev")) & (F.col("ibi") < F.col("next"))
    a, b = (F.col("next") - F.col("ibi")) / F.sqrt(F.lit(2.0)), (F.col("next") + F.col("ibi")) / F.sqrt(F.lit(2.0))
    g = d.groupBy("rec").agg(F.count("ibi").alias("n"), F.stddev_pop(a).alias("sd1"), F.stddev_pop(b).alias("sd2"), F.count_if(up | down).alias("turns"))
    return g.select("rec", "n", F.when(F.col("sd2") == 0, 0.0).otherwise(F.col("sd1") / F.col("sd2")).alias("sd1_sd2"), F.try_divide("turns", F.col("n") - 2).alias("tpr"))


def shannon_entropy(ibis: DataFrame, bins: int = 16, trim: int = 8, trim_above: int = 32, tie: str = "beat") -> DataFrame:
    """Per record: entropy of the interval histogram over its range, 0 to 1; long records lose their `trim` extremes."""
    w = Window.partitionBy("rec")
    r = ibis.withColumn("k", F.row_number().over(Window.partitionBy("rec").orderBy("ibi", tie))).withColumn("n", F.count(F.lit(1)).over(w))
    r = r.where((F.col("n") <= trim_above) | ((F.col("k") > trim) & (F.col("k") <= F.col("n") - trim)))
    r = r.withColumn("lo", F.min("ibi").over(w)).withColumn("hi", F.max("ibi").over(w)).withColumn("m", F.count(F.lit(1)).over(w))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("ibi") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    h = r.groupBy("rec", place.alias("bin")).agg((F.count(F.lit(1)) / F.first("m")).alias("p"))
    return h.groupBy("rec").agg((-F.sum(F.col("p") * F.log2("p")) / F.log2(F.lit(float(bins)))).alias("entropy"))


def sample_entropy(ibis: DataFrame, share: float = 0.2, t: str = "t", tie: str = "beat") -> DataFrame:
    """Per record: -ln(matches of 3 / matches of 2 intervals), tolerance `share` of the population deviation; the same
    templates for both lengths; 0 without a match of 2.

    A self join on the record and the first interval's place on a grid as wide as the tolerance, so only templates that can
    match by it meet.
    """
    w = by_time(t, tie)
    x = ibis.select("rec", F.row_number().over(w).alias("i"), F.col("ibi").alias("x0"), F.lead("ibi", 1).over(w).alias("x1"), F.lead("ibi", 2).over(w).alias("x2"), (share * F.stddev_pop("ibi").over(Window.partitionBy("rec"))).alias("tol")).where("x2 IS NOT NULL")
    # a cell and its neighbours hold all first intervals within the tolerance; without a tolerance only equal ones match
    cell = F.when(F.col("tol") > 0, F.floor(F.col("x0") / F.col("tol"))).otherwise(0)
    a, b = x.withColumn("cell", cell).alias("a"), x.withColumn("cell", F.explode(F.array(*[cell + k for k in (-1, 0, 1)]))).alias("b")
    two = (F.abs(F.col("a.x0") - F.col("b.x0")) <= F.col("a.tol")) & (F.abs(F.col("a.x1") - F.col("b.x1")) <= F.col("a.tol"))
    three = F.abs(F.col("a.x2") - F.col("b.x2")) <= F.col("a.tol")
    g = a.join(b, (F.col("a.rec") == F.col("b.rec")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.i") < F.col("b.i")) & two).groupBy(F.col("a.rec").alias("rec")).agg((F.lit(2) * F.count(F.lit(1))).alias("m2"), (F.lit(2) * F.count_if(three)).alias("m3"))
    g = x.select("rec").distinct().join(g, "rec", "left")
    return g.select("rec", F.when(F.col("m2") > 0, -F.ln(F.greatest("m3", F.lit(1)) / F.col("m2"))).otherwise(0.0).alias("sample_entropy"))


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2.0


def local_median(ibis: DataFrame, context: int = CONTEXT, t: str = "t", tie: str = "beat") -> DataFrame:
    """ibis with `local_median` at each beat: of up to `context` intervals on either side of the two that the beat
    belongs to; null with fewer than 3. (`ibi` ends at the beat, the one after it begins there.)"""
    w = by_time(t, tie)
    around = F.concat(F.collect_list("ibi").over(w.rowsBetween(-context, -1)), F.collect_list("ibi").over(w.rowsBetween(2, context + 1)))
    return ibis.withColumn("around", around).withColumn("local_median", F.when(F.size("around") >= 3, _median(F.col("around")))).drop("around")


def extra_beats(ibis: DataFrame, prematurity: float | Column = PREMATURITY, recovery: float | Column = RECOVERY, t: str = "t", tie: str = "beat") -> DataFrame:
    """ibis with `local_median`, `after` (the next interval) and `extra`: the interval before the beat is shorter than
    1 - prematurity and the one after longer than recovery of the local median. Records under 5 beats have none."""
    m = local_median(ibis, t=t, tie=tie).withColumn("after", F.lead("ibi").over(by_time(t, tie))).withColumn("beats", F.count(F.lit(1)).over(Window.partitionBy("rec")))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    hit = (F.col("beats") >= 5) & (F.col("ibi") < (1 - lit(prematurity)) * F.col("local_median")) & (F.col("after") > lit(recovery) * F.col("local_median"))
    return m.withColumn("extra", F.coalesce(hit, F.lit(False)))


def without_extra_beats(found: DataFrame, max_share: float = MAX_SHARE, t: str = "t", tie: str = "beat") -> DataFrame:
    """Intervals left when both beside each extra beat go; a record with too many extra beats keeps all of them."""
    w = Window.partitionBy("rec")
    r = found.withColumn("n_extra", F.count_if("extra").over(w)).withColumn("removed", (F.col("n_extra") > 0) & (F.col("n_extra") <= max_share * F.col("beats")))
    beside = F.col("extra") | F.coalesce(F.lag("extra").over(by_time(t, tie)), F.lit(False))
    return r.withColumn("beside", beside).where("ibi IS NOT NULL AND NOT (removed AND beside)").drop("beside")
