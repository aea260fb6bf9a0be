"""All queries of the engine by name, and the SQL that each is checked against.

The driver's tables have no physiological data; README lists what stands for what. Doubles are rounded in both forms, as
sums come in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsespark.operators import intervals as iv
from pulsespark.operators import matching, metrics, models, signals, spectra, trust
from pulsespark.settings import HR_LIMITS, IRREGULAR
from pulsespark.sources.tables import UNIT, beats, table
from pulsespark.sources.tables import signals as packed
from pulsespark.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BEATS = "beats AS (SELECT user_id AS rec, event_id AS beat, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, event_type AS symbol, value AS v FROM events)"
IBIS = BEATS + ", ibis AS (SELECT *, (us - lag(us) OVER (PARTITION BY rec ORDER BY us, beat)) / 3.6e10 AS ibi FROM beats)"
CLEAN = IBIS + ", clean AS (SELECT * FROM ibis WHERE ibi BETWEEN 0.3 AND 2.0), near AS (SELECT *, lag(ibi) OVER w AS prev, lead(ibi) OVER w AS next FROM clean WINDOW w AS (PARTITION BY rec ORDER BY us, beat))"
EXTRA = IBIS + """, m AS (SELECT *, lead(ibi) OVER w AS after, count(*) OVER (PARTITION BY rec) AS beats,
  list_concat(coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 2 FOLLOWING AND 9 FOLLOWING), [])) AS around
  FROM ibis WINDOW w AS (PARTITION BY rec ORDER BY us, beat)),
med AS (SELECT *, CASE WHEN len(around) >= 3 THEN list_median(around) END AS local_median FROM m)"""
FOUND = EXTRA + ", found AS (SELECT *, coalesce(beats >= 5 AND ibi < (1 - 0.15) * local_median AND after > 0.95 * local_median, false) AS extra FROM med)"
SAMPLES = "samples AS (SELECT vec_id AS rec, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def ibis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.intervals(beats(spark, sf_dir), "us", UNIT)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.clean(ibis(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark, sf_dir).select("rec", "label", F.posexplode("values").alias("i", "v"))


@query("ibi_nrmssd_sdnn", f"""WITH {CLEAN} SELECT rec, count(*) AS n, round(avg(ibi), 6) AS mean,
  round(CASE WHEN count(*) >= 3 THEN sqrt(avg(pow(ibi - prev, 2))) * 1000 END, 6) AS rmssd, round(CASE WHEN count(*) >= 3 THEN stddev_samp(ibi) * 1000 END, 6) AS sdnn,
  round(sqrt(avg(pow(ibi - prev, 2))) / avg(ibi), 6) AS nrmssd,
  CASE WHEN sqrt(avg(pow(ibi - prev, 2))) / avg(ibi) > 0.1 THEN 'irregular' WHEN sqrt(avg(pow(ibi - prev, 2))) IS NULL THEN 'insufficient' ELSE 'regular' END AS rhythm FROM near GROUP BY rec""")
def ibi_nrmssd_sdnn(spark, sf_dir):
    g = iv.variability(clean(spark, sf_dir), "us")
    return rounded(g.withColumn("rhythm", F.when(F.col("nrmssd") > IRREGULAR, "irregular").when(F.col("nrmssd").isNull(), "insufficient").otherwise("regular")))


@query("ibi_poincare_turning", f"""WITH {CLEAN} SELECT rec, count(*) AS n,
  round(CASE WHEN stddev_pop((next + ibi) / sqrt(2.0)) = 0 THEN 0.0 ELSE stddev_pop((next - ibi) / sqrt(2.0)) / stddev_pop((next + ibi) / sqrt(2.0)) END, 6) AS sd1_sd2,
  round(CASE WHEN count(*) <> 2 THEN count(*) FILTER (WHERE (ibi > prev AND ibi > next) OR (ibi < prev AND ibi < next)) / (count(*) - 2.0::DOUBLE) END, 6) AS tpr FROM near GROUP BY rec""")
def ibi_poincare_turning(spark, sf_dir):
    return rounded(iv.poincare(clean(spark, sf_dir), "us"))


@query("ibi_shannon_entropy", f"""WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY ibi, beat) AS k, count(*) OVER (PARTITION BY rec) AS n FROM clean),
  s AS (SELECT rec, ibi, min(ibi) OVER w AS lo, max(ibi) OVER w AS hi, count(*) OVER w AS m FROM r WHERE n <= 32 OR (k > 8 AND k <= n - 8) WINDOW w AS (PARTITION BY rec)),
  h AS (SELECT rec, CASE WHEN hi > lo THEN least(floor((ibi - lo) / (hi - lo) * 16), 15) ELSE 0 END AS bin, count(*) / any_value(m)::DOUBLE AS p FROM s GROUP BY 1, 2)
  SELECT rec, round(-sum(p * log2(p)) / 4, 6) + 0.0 AS entropy FROM h GROUP BY rec""")
def ibi_shannon_entropy(spark, sf_dir):
    return iv.shannon_entropy(clean(spark, sf_dir)).select("rec", (F.round("entropy", 6) + F.lit(0.0)).alias("entropy"))


@query("ibi_sample_entropy", f"""WITH {CLEAN}, x AS (SELECT rec, row_number() OVER w AS i, ibi AS x0, lead(ibi, 1) OVER w AS x1, lead(ibi, 2) OVER w AS x2, 0.2 * stddev_pop(ibi) OVER (PARTITION BY rec) AS tol FROM clean WINDOW w AS (PARTITION BY rec ORDER BY us, beat)),
  y AS (SELECT * FROM x WHERE x2 IS NOT NULL),
  g AS (SELECT a.rec, 2 * count(*) AS m2, 2 * count(*) FILTER (WHERE abs(a.x2 - b.x2) <= a.tol) AS m3 FROM y a JOIN y b ON a.rec = b.rec AND a.i < b.i AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY a.rec)
  SELECT r.rec, round(CASE WHEN m2 > 0 THEN -ln(greatest(m3, 1) / m2::DOUBLE) ELSE 0.0 END, 6) + 0.0 AS sample_entropy FROM (SELECT DISTINCT rec FROM y) r LEFT JOIN g ON r.rec = g.rec""")
def ibi_sample_entropy(spark, sf_dir):
    return iv.sample_entropy(clean(spark, sf_dir), t="us").select("rec", (F.round("sample_entropy", 6) + F.lit(0.0)).alias("sample_entropy"))


@query("local_median_centred", f"WITH {EXTRA} SELECT rec, beat, round(local_median, 6) AS local_median FROM med")
def local_median_centred(spark, sf_dir):
    return rounded(iv.local_median(ibis(spark, sf_dir), t="us").select("rec", "beat", "local_median"))


@query("extra_beats_detect", f"WITH {FOUND} SELECT rec, count(*) AS beats, count(*) FILTER (WHERE extra) AS extra FROM found GROUP BY rec")
def extra_beats_detect(spark, sf_dir):
    return iv.extra_beats(ibis(spark, sf_dir), t="us").groupBy("rec").agg(F.count(F.lit(1)).alias("beats"), F.count_if("extra").alias("extra"))


@query("extra_beats_removed_ibis", f"""WITH {FOUND}, n AS (SELECT *, count(*) FILTER (WHERE extra) OVER (PARTITION BY rec) AS n_extra, lag(extra) OVER (PARTITION BY rec ORDER BY us, beat) AS was FROM found)
  SELECT rec, beat, round(ibi, 6) AS ibi, n_extra > 0 AND n_extra <= 0.2 * beats AS removed FROM n
  WHERE ibi IS NOT NULL AND NOT (n_extra > 0 AND n_extra <= 0.2 * beats AND (extra OR coalesce(was, false)))""")
def extra_beats_removed_ibis(spark, sf_dir):
    return rounded(iv.without_extra_beats(iv.extra_beats(ibis(spark, sf_dir), t="us"), t="us").select("rec", "beat", "ibi", "removed"))


GRID = [(p / 100, r / 100) for p in range(8, 26, 2) for r in range(75, 115, 5)]


@query("rule_grid_tune_top1", f"""WITH {EXTRA}, rules AS (SELECT p / 100.0::DOUBLE AS prematurity, r / 100.0::DOUBLE AS recovery FROM range(8, 26, 2) a(p), range(75, 115, 5) b(r)),
  hits AS (SELECT prematurity, recovery, coalesce(beats >= 5 AND ibi < (1 - prematurity) * local_median AND after > recovery * local_median, false) AS hit, symbol = 'error' AS truth FROM med, rules WHERE symbol <> 'purchase'),
  c AS (SELECT prematurity, recovery, count(*) FILTER (WHERE hit AND truth) AS tp, count(*) FILTER (WHERE hit AND NOT truth) AS fp, count(*) FILTER (WHERE NOT hit AND truth) AS fn FROM hits GROUP BY 1, 2)
  SELECT prematurity, recovery, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 6) AS f1 FROM c ORDER BY 2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE DESC, prematurity, recovery LIMIT 1""")
def rule_grid_tune_top1(spark, sf_dir):
    """Every rule of the grid on every beat, pooled; the grid is a fixed list, so this explodes rows by a constant."""
    m = iv.extra_beats(ibis(spark, sf_dir), t="us").where("symbol <> 'purchase'").select("symbol", "ibi", "after", "local_median", "beats")
    grid = spark.createDataFrame(GRID, "prematurity double, recovery double")
    r = m.crossJoin(F.broadcast(grid))
    hit = F.coalesce((F.col("beats") >= 5) & (F.col("ibi") < (1 - F.col("prematurity")) * F.col("local_median")) & (F.col("after") > F.col("recovery") * F.col("local_median")), F.lit(False))
    g = metrics.detection(r, hit, F.col("symbol") == "error", "prematurity", "recovery")
    return rounded(g.orderBy(F.desc("f1"), "prematurity", "recovery").limit(1).select("prematurity", "recovery", "f1"))


@query("rhythm_fill_forward", f"""WITH {BEATS}, s AS (SELECT *, CASE symbol WHEN 'signup' THEN true WHEN 'view' THEN false END AS mark FROM beats),
  f AS (SELECT rec, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, beat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_af FROM s)
  SELECT rec, count(*) AS beats, count(*) FILTER (WHERE in_af) AS in_af FROM f GROUP BY rec""")
def rhythm_fill_forward(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("mark", F.when(F.col("symbol") == "signup", True).when(F.col("symbol") == "view", False))
    f = matching.fill_forward(b, "mark", "in_af", ["us", "beat"])
    return f.groupBy("rec").agg(F.count(F.lit(1)).alias("beats"), F.count_if(F.coalesce("in_af", F.lit(False))).alias("in_af"))


@query("window_purity", f"""WITH {BEATS}, s AS (SELECT *, CASE symbol WHEN 'signup' THEN true WHEN 'view' THEN false END AS mark FROM beats),
  f AS (SELECT rec, us // 86400000000 AS win, symbol, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, beat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS in_af FROM s)
  SELECT rec, win, count(*) AS beats, bool_and(in_af) AS af, round(avg(CASE WHEN symbol = 'error' THEN 1.0 ELSE 0.0 END), 6) AS extra_share FROM f GROUP BY rec, win HAVING count(*) >= 3 AND bool_and(in_af) = bool_or(in_af)""")
def window_purity(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("mark", F.when(F.col("symbol") == "signup", True).when(F.col("symbol") == "view", False))
    f = matching.fill_forward(b, "mark", "in_af", ["us", "beat"]).withColumn("in_af", F.coalesce("in_af", F.lit(False))).withColumn("win", F.floor(F.col("us") / 86400000000))
    g = f.groupBy("rec", "win").agg(F.count(F.lit(1)).alias("beats"), F.every("in_af").alias("af"), F.some("in_af").alias("any_af"), F.avg(F.when(F.col("symbol") == "error", 1.0).otherwise(0.0)).alias("extra_share"))
    return rounded(g.where("beats >= 3 AND af = any_af").drop("any_af"))


ASOF = f"""WITH {BEATS}, r AS (SELECT * FROM beats WHERE symbol = 'click'), p AS (SELECT * FROM beats WHERE symbol = 'error'),
  b AS (SELECT r.rec, r.beat, r.us, max(p.us) FILTER (WHERE p.us <= r.us) AS back, min(p.us) FILTER (WHERE p.us >= r.us) AS ahead FROM r LEFT JOIN p ON r.rec = p.rec GROUP BY r.rec, r.beat, r.us),
  n AS (SELECT rec, beat, us, CASE WHEN ahead IS NULL OR us - back <= ahead - us THEN back ELSE ahead END AS match FROM b)"""


@query("nearest_beat_asof", f"{ASOF} SELECT rec, beat, us, match FROM n")
def nearest_beat_asof(spark, sf_dir):
    b = beats(spark, sf_dir).select("rec", "beat", "us", "symbol")
    return matching.nearest(b.where("symbol = 'click'").drop("symbol"), b.where("symbol = 'error'"), "us")


@query("ibi_error_ms", f"""{ASOF}, ranks AS (SELECT rec, us, row_number() OVER (PARTITION BY rec ORDER BY us, beat) AS k FROM p),
  m AS (SELECT n.rec, n.us, n.match, k, row_number() OVER (PARTITION BY n.rec ORDER BY n.us, n.beat) AS i FROM n LEFT JOIN ranks ON n.rec = ranks.rec AND n.match = ranks.us AND abs(n.us - n.match) <= 3.6e10),
  d AS (SELECT *, lead(us) OVER w AS us1, lead(match) OVER w AS match1, lead(k) OVER w AS k1 FROM m WINDOW w AS (PARTITION BY rec ORDER BY i))
  SELECT rec, count(*) AS pairs, round(avg(abs((us1 - us) - (match1 - match))) / 3.6e10 * 1000, 6) AS error FROM d WHERE k1 = k + 1 GROUP BY rec""")
def ibi_error_ms(spark, sf_dir):
    b = beats(spark, sf_dir).select("rec", "beat", "us", "symbol")
    p = b.where("symbol = 'error'")
    ranks = p.select("rec", F.col("us").alias("match"), F.row_number().over(iv.by_time("us", "beat")).alias("k"))
    n = matching.nearest(b.where("symbol = 'click'").drop("symbol"), p, "us")
    m = n.join(ranks, ["rec", "match"], "left").withColumn("k", F.when(F.abs(F.col("us") - F.col("match")) <= UNIT, F.col("k")))
    w = iv.by_time("us", "beat")
    d = m.withColumn("gap", F.lead("us").over(w) - F.col("us")).withColumn("other", F.lead("match").over(w) - F.col("match")).withColumn("k1", F.lead("k").over(w))
    return rounded(d.where("k1 = k + 1").groupBy("rec").agg(F.count(F.lit(1)).alias("pairs"), (F.avg(F.abs(F.col("gap") - F.col("other"))) / UNIT * 1000).alias("error")))


@query("interval_join_windows", f"""WITH {BEATS}, w AS (SELECT rec, us AS start FROM beats WHERE symbol = 'signup')
  SELECT w.rec, start, count(*) AS beats, round(sum(v), 4) AS total FROM w JOIN beats b ON b.rec = w.rec AND b.us >= start AND b.us < start + 86400000000 GROUP BY w.rec, start""")
def interval_join_windows(spark, sf_dir):
    b = beats(spark, sf_dir)
    w = b.where("symbol = 'signup'").select("rec", F.col("us").alias("start"))
    g = matching.in_windows(b, w, 86400000000, "us").groupBy("rec", "start").agg(F.count(F.lit(1)).alias("beats"), F.sum("v").alias("total"))
    return rounded(g, 4)


@query("gap_fill_linear", """WITH x AS (SELECT user_id AS rec, event_id AS beat, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS us, CASE WHEN event_type <> 'error' THEN value END AS v FROM events),
  y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'t': us, 'v': v} END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, beat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
    first_value(CASE WHEN v IS NOT NULL THEN {'t': us, 'v': v} END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY us, beat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM x)
  SELECT rec, beat, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN b.v WHEN b IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ((us - a.t) / (b.t - a.t)::DOUBLE) END, 6) AS filled FROM y""")
def gap_fill_linear(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("v", F.when(F.col("symbol") != "error", F.col("v")))
    return rounded(matching.fill_gaps(b, "v", "us", "filled", "beat").select("rec", "beat", "filled"))


@query("moving_rms_gradient", f"""WITH {BEATS} SELECT rec, beat, round(sqrt(avg(v * v) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)), 6) AS rms,
  round(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 6) AS gradient FROM beats WINDOW w AS (PARTITION BY rec ORDER BY us, beat)""")
def moving_rms_gradient(spark, sf_dir):
    b = trust.gradient(trust.moving_rms(beats(spark, sf_dir), "v", ["us", "beat"], 5), "v", ["us", "beat"])
    return rounded(b.select("rec", "beat", "rms", "gradient"))


@query("parabolic_peaks", f"""WITH {SAMPLES}, t AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c FROM samples WINDOW w AS (PARTITION BY rec ORDER BY i))
  SELECT rec, i, round(i + CASE WHEN a - 2 * v + c <> 0 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * v + c))) ELSE 0 END, 6) AS place FROM t WHERE v > a AND v > c""")
def parabolic_peaks(spark, sf_dir):
    w = Window.partitionBy("rec").orderBy("i")
    t = samples(spark, sf_dir).withColumn("a", F.lag("v").over(w)).withColumn("c", F.lead("v").over(w)).where("v > a AND v > c")
    bend = F.col("a") - 2 * F.col("v") + F.col("c")
    shift = F.coalesce(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.try_divide(0.5 * (F.col("a") - F.col("c")), bend))), F.lit(0.0))
    return rounded(t.select("rec", F.col("i").cast("long").alias("i"), (F.col("i") + shift).alias("place")))


@query("dft_peak_share_snr", f"""WITH {SAMPLES}, c AS (SELECT rec, i, v - avg(v) OVER (PARTITION BY rec) AS v FROM samples),
  p AS (SELECT rec, k, sum(v * cos(k * (2 * pi() / 64) * i)) ^ 2 + sum(v * sin(k * (2 * pi() / 64) * i)) ^ 2 AS power, k * (30.0::DOUBLE / 64) AS f FROM c, range(1, 32) r(k) GROUP BY rec, k),
  top AS (SELECT rec, arg_max(f, power) AS f0 FROM p WHERE f BETWEEN 0.5 AND 3.3 GROUP BY rec),
  g AS (SELECT rec, f0, sum(power) FILTER (WHERE abs(f - f0) <= 0.1 AND f BETWEEN 0.5 AND 3.3) AS near, sum(power) FILTER (WHERE f BETWEEN 0.5 AND 3.3) AS band,
    sum(power) FILTER (WHERE abs(f - f0) <= 0.1 OR abs(f - 2 * f0) <= 0.1) AS signal, sum(power) FILTER (WHERE f BETWEEN 0.5 AND 3.3 AND NOT (abs(f - f0) <= 0.1 OR abs(f - 2 * f0) <= 0.1)) AS noise FROM p JOIN top USING (rec) GROUP BY rec, f0)
  SELECT rec, round(f0 * 60, 5) AS rate, round(near / band, 5) AS peak_share, round(10 * log10(signal / noise), 5) AS snr_db FROM g""")
def dft_peak_share_snr(spark, sf_dir):
    p = spectra.dft_power(packed(spark, sf_dir), list(range(1, 32)), 64)
    return rounded(spectra.peak(p, 30.0, 64), 5)


@query("xcorr_best_lag", f"""WITH {SAMPLES}, x AS (SELECT rec, i, v FROM samples), y AS (SELECT rec - 1 AS rec, i, v AS w FROM samples),
  c AS (SELECT x.rec, lag, corr(v, w) AS c FROM x, range(-8, 9) l(lag) JOIN y ON y.rec = x.rec AND y.i = x.i + lag GROUP BY x.rec, lag)
  SELECT rec, arg_max(lag, round(abs(c), 9) * 1000 - lag / 1e9) AS lag FROM c GROUP BY rec""")
def xcorr_best_lag(spark, sf_dir):
    s = samples(spark, sf_dir)
    other = s.select((F.col("rec") - 1).alias("rec"), "i", F.col("v").alias("y"))
    return matching.best_lag(s.select("rec", "i", F.col("v").alias("x")).join(other, ["rec", "i"]), 8).select("rec", F.col("lag").cast("long").alias("lag"))


@query("loo_consistency", f"""WITH {SAMPLES}, s AS (SELECT label, rec AS patch, v, sum(v) OVER (PARTITION BY label, i) - v AS rest FROM samples)
  SELECT label AS rec, patch, round(greatest(0, least(1, corr(v, rest))), 6) AS consistency FROM s GROUP BY label, patch""")
def loo_consistency(spark, sf_dir):
    return rounded(trust.consistency(samples(spark, sf_dir).select(F.col("label").alias("rec"), F.col("rec").alias("patch"), "i", "v")))


LUMA_SQL = "0.299 * l_extendedprice / 400 + 0.587 * l_discount * 2000 + 0.114 * l_tax * 2000"


@query("facing_brightness_weights", f"""WITH x AS (SELECT l_orderkey, CASE WHEN coalesce(l_quantity / 50, 0) < 0.3 THEN 0.0 ELSE l_quantity / 50 END AS facing, {LUMA_SQL} AS y FROM lineitem)
  SELECT l_orderkey % 1000 AS rec, count(*) AS n, round(sum(facing * greatest(0, least(1, (y - 20.0) / 25.0)) * (1 - greatest(0, least(1, (y - 220.0) / 25.0)))), 4) AS weight FROM x GROUP BY 1""")
def facing_brightness_weights(spark, sf_dir):
    y = trust.luma(F.col("l_extendedprice") / 400, F.col("l_discount") * 2000, F.col("l_tax") * 2000)
    w = trust.facing_weight(F.col("l_quantity") / 50) * trust.brightness_weight(y)
    return rounded(table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 1000).alias("rec")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight")), 4)


@query("patch_merge_weighted", """SELECT l_orderkey AS rec, l_linenumber % 3 AS grp, round(sum(l_quantity), 4) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS r, round(sum(l_tax * l_quantity) / sum(l_quantity), 9) AS g FROM lineitem GROUP BY 1, 2""")
def patch_merge_weighted(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), (F.col("l_linenumber") % 3).alias("grp"), "l_quantity", F.col("l_discount").alias("r"), F.col("l_tax").alias("g"))
    m = trust.merge_weighted(l, "l_quantity", ["r", "g"], "rec", "grp")
    return m.select("rec", "grp", F.round("weight", 4).alias("weight"), F.round("r", 9).alias("r"), F.round("g", 9).alias("g"))


@query("hann_overlap_add", f"""WITH {SAMPLES}, seg AS (SELECT rec, s AS start, i - s AS k, v FROM samples, (VALUES (0), (16), (32)) z(s) WHERE i >= s AND i < s + 32),
  h AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() / 33 * (k + 1)) AS h FROM seg) SELECT rec, start + k AS i, round(sum(v * h) / greatest(sum(h), 1e-9), 5) + 0.0 AS v FROM h GROUP BY rec, start + k""")
def hann_overlap_add(spark, sf_dir):
    seg = packed(spark, sf_dir).withColumn("start", F.explode(F.array(F.lit(0), F.lit(16), F.lit(32)))).withColumn("values", F.slice("values", F.col("start") + 1, F.lit(32)))
    return rounded(trust.overlap_add(seg.select("rec", "start", "values"), 32).select("rec", F.col("i").cast("long").alias("i"), (F.round("v", 5) + F.lit(0.0)).alias("v")), 5)


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("sliding_counts", f"""WITH {BEATS}, w AS (SELECT rec, (us // 3600000000 - k) * 3600000000 AS start FROM beats, range(0, 8) r(k)) SELECT rec, start, count(*) AS beats FROM w GROUP BY rec, start""")
def sliding_counts(spark, sf_dir):
    """8-hour windows every hour: each beat falls into 8 of them, by integer arithmetic."""
    b = beats(spark, sf_dir)
    w = b.select("rec", F.floor(F.col("us") / 3600000000).alias("hour"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    return w.select("rec", ((F.col("hour") - F.col("k")) * 3600000000).alias("start")).groupBy("rec", "start").agg(F.count(F.lit(1)).alias("beats"))


@query("session_counts", f"""WITH {BEATS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY rec ORDER BY us, beat) < 21600000000 THEN 0 ELSE 1 END AS new FROM beats),
  s AS (SELECT *, sum(new) OVER (PARTITION BY rec ORDER BY us, beat ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT rec, min(us) AS start, count(*) AS beats FROM s GROUP BY rec, k""")
def session_counts(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    return b.groupBy("rec", F.session_window("ts", "6 hours")).agg(F.min("us").alias("start"), F.count(F.lit(1)).alias("beats")).select("rec", "start", "beats")


@query("summary_metrics", """SELECT user_id % 10 AS grp, count(*) AS n, round(avg(abs(value - e.k)), 5) AS mae, round(stddev_samp(abs(value - e.k)) / sqrt(count(*)), 5) AS mae_se, round(sqrt(avg((value - e.k) * (value - e.k))), 5) AS rmse,
  round(avg(CASE WHEN e.k <> 0 THEN abs((value - e.k) / e.k) END) * 100, 5) AS mape, round(CASE WHEN count(*) >= 3 THEN corr(value, e.k) END, 5) AS pearson FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) e GROUP BY 1""")
def summary_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("grp"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return rounded(metrics.summarize(e, "value", "k", "grp"), 5)


@query("kappa_labels", """WITH c AS (SELECT quality AS p, toxic AS t, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE p = t) AS hit FROM c),
  m AS (SELECT coalesce(a.x, b.x) AS x, coalesce(a.n, 0) * coalesce(b.n, 0) AS pt FROM (SELECT p AS x, sum(n) AS n FROM c GROUP BY p) a FULL JOIN (SELECT t AS x, sum(n) AS n FROM c GROUP BY t) b ON a.x = b.x)
  SELECT n::BIGINT AS n, round(hit / n, 6) AS accuracy, round((hit / n - pt / (n * n)) / (1 - pt / (n * n)), 6) AS kappa FROM s, (SELECT sum(pt) AS pt FROM m)""")
def kappa_labels(spark, sf_dir):
    return rounded(metrics.kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("crosstab_dense", """WITH d AS (SELECT a.x AS o_orderpriority, b.y AS o_orderstatus FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('none')) a(x), (VALUES ('F'), ('O'), ('X')) b(y))
  SELECT d.o_orderpriority, d.o_orderstatus, count(o.o_orderkey) AS n FROM d LEFT JOIN orders o ON o.o_orderpriority = d.o_orderpriority AND o.o_orderstatus = d.o_orderstatus GROUP BY 1, 2""")
def crosstab_dense(spark, sf_dir):
    dim = spark.createDataFrame([(x, y) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "none") for y in ("F", "O", "X")], "o_orderpriority string, o_orderstatus string")
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dim).join(n, ["o_orderpriority", "o_orderstatus"], "left").select("o_orderpriority", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("roc_auc_rank", """WITH x AS (SELECT l_returnflag AS grp, l_quantity AS s, l_linestatus = 'O' AS y FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY s) + (count(*) OVER (PARTITION BY grp, s) - 1) / 2.0 AS k FROM x)
  SELECT grp, round((sum(k) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE NOT y))::DOUBLE, 0), 6) AS auc, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM r GROUP BY grp""")
def roc_auc_rank(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("s"), "l_linestatus")
    return rounded(metrics.auc(x, "s", F.col("l_linestatus") == "O", "grp"))


@query("group_plus_all", "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus)")
def group_plus_all(spark, sf_dir):
    return rounded(metrics.with_total(table(spark, sf_dir, "orders"), "o_orderstatus", F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@query("describe_shares", "SELECT event_type, count(value) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS min, round(quantile_cont(value, 0.1), 5) AS p10, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90, max(value) AS max FROM events GROUP BY 1")
def describe_shares(spark, sf_dir):
    return rounded(metrics.describe(table(spark, sf_dir, "events"), "value", "event_type"), 5)


@query("pivot_scenarios", "SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY 1")
def pivot_scenarios(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.round(F.avg("o_totalprice"), 4))
    return p.select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("5-LOW").alias("low"))


@query("false_alarm_summary", """WITH w AS (SELECT l_returnflag AS variant, l_suppkey AS video, l_discount >= 0.05 AS alarm, l_quantity >= 25 AS reliable FROM lineitem),
  v AS (SELECT variant, video, avg(CASE WHEN alarm THEN 1.0 ELSE 0.0 END) FILTER (WHERE reliable) >= 0.5 AS called FROM w GROUP BY 1, 2)
  SELECT a.*, b.video_rate FROM (SELECT variant, round(avg(CASE WHEN alarm THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN alarm THEN 1.0 ELSE 0.0 END) FILTER (WHERE reliable), 6) AS gated_rate, round(avg(CASE WHEN reliable THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM w GROUP BY 1) a
  JOIN (SELECT variant, round(avg(CASE WHEN called THEN 1.0 ELSE 0.0 END), 6) AS video_rate FROM v GROUP BY 1) b USING (variant)""")
def false_alarm_summary(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_suppkey").alias("video"), (F.col("l_discount") >= 0.05).cast("double").alias("alarm"), (F.col("l_quantity") >= 25).alias("reliable"))
    gated = F.when(F.col("reliable"), F.col("alarm"))
    a = w.groupBy("variant").agg(F.avg("alarm").alias("rate"), F.avg(gated).alias("gated_rate"), F.avg(F.col("reliable").cast("double")).alias("coverage"))
    v = w.groupBy("variant", "video").agg(F.avg(gated).alias("p")).groupBy("variant").agg(F.avg(F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)).alias("video_rate"))
    return rounded(a.join(v, "variant"))


@query("hr_flags_decide", f"""WITH {CLEAN}, r AS (SELECT rec, us // 604800000000 AS seg, 60 / median(ibi) AS hr, count(*) AS n FROM clean GROUP BY 1, 2) SELECT rec, seg, round(hr, 5) AS hr, CASE WHEN n < 6 THEN 'insufficient' WHEN hr < 50 THEN 'slow' WHEN hr > 100 THEN 'fast' ELSE 'normal' END AS flag FROM r""")
def hr_flags_decide(spark, sf_dir):
    """A flag for each segment (a week) of a record."""
    g = clean(spark, sf_dir).groupBy("rec", F.floor(F.col("us") / 604800000000).alias("seg")).agg((60 / F.median("ibi")).alias("hr"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("rec", "seg", "hr", F.when(F.col("n") < 6, "insufficient").when(F.col("hr") < HR_LIMITS[0], "slow").when(F.col("hr") > HR_LIMITS[1], "fast").otherwise("normal").alias("flag")), 5)


@query("set_ops_catalog", """(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)""")
def set_ops_catalog(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


@query("held_out_subjects", f"""WITH {CLEAN}, f AS (SELECT rec % 10 AS subject, avg(ibi) AS m, count(*) AS n FROM clean GROUP BY 1) SELECT a.subject, round(a.m, 6) AS own, round(sum(b.m * b.n) / sum(b.n), 6) AS others FROM f a JOIN f b ON a.subject <> b.subject GROUP BY 1, 2""")
def held_out_subjects(spark, sf_dir):
    """Per subject a statistic of all others: sums less the subject's own, so no fold reads the data again."""
    f = clean(spark, sf_dir).groupBy((F.col("rec") % 10).alias("subject")).agg(F.sum("ibi").alias("s"), F.count(F.lit(1)).alias("n"))
    total = f.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return rounded(f.join(F.broadcast(total)).select("subject", (F.col("s") / F.col("n")).alias("own"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("others")))


@query("filtered_beats")
def filtered_beats(spark, sf_dir):
    """Detrended, band-passed pulses, their beats, rates and shapes; tests hold the kernels against synthetic truth."""
    b = signals.beats(signals.filtered(packed(spark, sf_dir), 30.0), 30.0)
    return b.select("rec", F.size("beats").alias("n_beats"), "rate", "shape")


@query("colour_pulse_pos")
def colour_pulse_pos(spark, sf_dir):
    """The pulse of three neighbouring signals taken as colours; tests hold the kernel against synthetic colours."""
    s = packed(spark, sf_dir).select(F.floor(F.col("rec") / 3).alias("rec"), (F.col("rec") % 3).alias("c"), F.transform("values", lambda x: x + 10.0).alias("values"))
    one = lambda k: F.max_by("values", F.col("c") == k)
    g = s.groupBy("rec").agg(F.count(F.lit(1)).alias("n"), one(0).alias("r"), one(1).alias("g"), one(2).alias("b")).where("n = 3")
    p = signals.colour_pulse(g, 30.0)
    return p.select("rec", F.size("values").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


@query("gating_sweep", f"""WITH s AS (SELECT l_quantity / 50 AS gate, l_linestatus = 'O' AS y, l_discount * 10 AS p FROM lineitem), t AS (SELECT x / 4.0::DOUBLE AS threshold FROM range(0, 4) r(x)),
  k AS (SELECT threshold, y, p, rank() OVER (PARTITION BY threshold ORDER BY p) + (count(*) OVER (PARTITION BY threshold, p) - 1) / 2.0 AS r FROM s JOIN t ON gate >= threshold),
  n AS (SELECT count(*) FILTER (WHERE y) AS tp, count(*) FILTER (WHERE NOT y) AS tq FROM s)
  SELECT threshold, round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE NOT y))::DOUBLE), 6) AS auc,
    round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE y), 6) AS sensitivity, round(1 - avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT y), 6) AS specificity,
    round(count(*) FILTER (WHERE y) / any_value(tp)::DOUBLE, 6) AS coverage_1, round(count(*) FILTER (WHERE NOT y) / any_value(tq)::DOUBLE, 6) AS coverage_0 FROM k, n GROUP BY threshold""")
def gating_sweep(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("gate"), (F.col("l_linestatus") == "O").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return rounded(models.gating_sweep(s, "gate", [0.0, 0.25, 0.5, 0.75], "y"))


@query("screening_decision", f"""WITH w AS (SELECT l_suppkey AS rec, l_discount * 10 AS p, l_quantity >= 25 AS reliable FROM lineitem), g AS (SELECT rec, avg(p) FILTER (WHERE reliable) AS mean_p, avg(CASE WHEN reliable THEN 1.0 ELSE 0.0 END) AS coverage FROM w GROUP BY rec)
  SELECT rec, round(mean_p, 9) AS mean_p, round(coverage, 9) AS coverage, CASE WHEN mean_p IS NULL THEN 'unreliable' WHEN round(mean_p, 9) >= 0.5 THEN 'possible AF' ELSE 'regular rhythm' END AS decision FROM g""")
def screening_decision(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec"), (F.col("l_discount") * 10).alias("p"), (F.col("l_quantity") >= 25).alias("reliable"))
    return rounded(models.decide(w, "rec"), 9)


@query("stream_monitor_replay", f"""WITH {BEATS} SELECT rec, us // 86400000000 AS day, count(*) AS beats, round(sum(v), 4) AS total FROM beats GROUP BY 1, 2""")
def stream_monitor_replay(spark, sf_dir):
    return monitor.replay(spark, f"{sf_dir}/events.parquet")
