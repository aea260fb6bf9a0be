"""Queries of reports, grids and orders, registered beside those of the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsespark.operators import intervals as iv
from pulsespark.operators import metrics, reports
from pulsespark.plans.catalog import BEATS, FOUND, ibis, query, rounded
from pulsespark.sources.tables import beats, table

STEP = 21_600_000_000


@query("resample_grid", f"""WITH {BEATS}, s AS (SELECT rec, beat, us, CASE WHEN symbol <> 'error' THEN v END AS x FROM beats),
  e AS (SELECT rec, min(us) AS t0, max(us) AS t1, count(x) AS known FROM s GROUP BY rec),
  g AS (SELECT rec, known, t0 + unnest(range(0, t1 - t0, {STEP})) AS g FROM e),
  n AS (SELECT g.rec, g, known, (SELECT max((us, beat)) FROM s WHERE s.rec = g.rec AND us <= g) AS lo, (SELECT min((us, beat)) FROM s WHERE s.rec = g.rec AND us >= g) AS hi,
    (SELECT max((us, beat)) FROM s WHERE s.rec = g.rec AND us <= g AND x IS NOT NULL) AS a, (SELECT min((us, beat)) FROM s WHERE s.rec = g.rec AND us >= g AND x IS NOT NULL) AS b FROM g),
  k AS (SELECT n.*, CASE WHEN g - lo[1] < hi[1] - g THEN lo[2] ELSE hi[2] END AS near FROM n)
  SELECT k.rec, g, round(CASE WHEN s.x IS NOT NULL AND known >= 2 THEN CASE WHEN a IS NULL THEN sb.x WHEN b IS NULL OR a[1] = b[1] THEN sa.x ELSE sa.x + (sb.x - sa.x) * (g - a[1]) / (b[1] - a[1]) END END, 6) AS value
  FROM k JOIN s ON s.rec = k.rec AND s.beat = near LEFT JOIN s sa ON sa.rec = k.rec AND sa.beat = a[2] LEFT JOIN s sb ON sb.rec = k.rec AND sb.beat = b[2]""")
def resample_grid(spark, sf_dir):
    b = beats(spark, sf_dir).withColumn("v", F.when(F.col("symbol") != "error", F.col("v")))
    return rounded(reports.resample(b, STEP))


@query("natural_sort_head", r"""WITH n AS (SELECT o_custkey % 7 AS g, 'rec' || (o_orderkey % 137) || '_' || o_orderkey AS name FROM orders),
  k AS (SELECT *, regexp_extract(name, 'rec(\d+)_(\d+)', 1)::BIGINT AS a, regexp_extract(name, 'rec(\d+)_(\d+)', 2)::BIGINT AS b FROM n)
  SELECT g, name, place FROM (SELECT g, name, row_number() OVER (PARTITION BY g ORDER BY a, b) AS place FROM k) WHERE place <= 5""")
def natural_sort_head(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("g"), F.concat(F.lit("rec"), F.col("o_orderkey") % 137, F.lit("_"), "o_orderkey").alias("name"))
    return reports.head_by(o, 5, reports.natural_key(F.col("name")), by=["g"]).select("g", "name", F.col("place").cast("long").alias("place"))


@query("distinct_first_member", f"WITH {BEATS} SELECT rec, symbol, beat, us FROM (SELECT *, row_number() OVER (PARTITION BY rec, symbol ORDER BY us, beat) AS k FROM beats) WHERE k = 1")
def distinct_first_member(spark, sf_dir):
    return reports.distinct_first(beats(spark, sf_dir).select("rec", "symbol", "beat", "us"), ["rec", "symbol"], ["us", "beat"])


@query("union_distinct_sets", "SELECT o_custkey AS member FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def union_distinct_sets(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("member")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("first_offset", f"WITH {BEATS} SELECT rec, beat, (us - min(us) OVER (PARTITION BY rec)) / 1e6 AS seconds FROM beats")
def first_offset(spark, sf_dir):
    return beats(spark, sf_dir).select("rec", "beat", ((F.col("us") - F.min("us").over(Window.partitionBy("rec"))) / 1e6).alias("seconds"))


SCORED = f"{FOUND}, scored AS (SELECT *, symbol = 'error' AS truth FROM found WHERE symbol <> 'purchase')"


def scored(spark, sf_dir):
    return iv.extra_beats(ibis(spark, sf_dir), t="us").where("symbol <> 'purchase'").withColumn("truth", F.col("symbol") == "error")


@query("score_by_record", f"""WITH {SCORED} SELECT rec, count(*) AS beats, count(*) FILTER (WHERE truth) AS premature, count(*) FILTER (WHERE extra AND truth) AS tp,
  count(*) FILTER (WHERE extra AND NOT truth) AS fp, count(*) FILTER (WHERE NOT extra AND truth) AS fn, count(*) FILTER (WHERE extra AND symbol = 'click') AS tp_click, count(*) FILTER (WHERE symbol = 'click') AS n_click FROM scored GROUP BY rec""")
def score_by_record(spark, sf_dir):
    return reports.scores_by_record(scored(spark, sf_dir), F.col("extra"), F.col("truth"), {"click": F.col("symbol") == "click"})


@query("extra_beats_per_subject", f"""WITH {FOUND}, w AS (SELECT rec, us // 86400000000 AS win, count(*) FILTER (WHERE extra) AS n_extra FROM found GROUP BY 1, 2)
  SELECT rec, count(*) AS windows, round(avg(n_extra), 6) AS extra_per_window FROM w GROUP BY rec""")
def extra_beats_per_subject(spark, sf_dir):
    f = iv.extra_beats(ibis(spark, sf_dir), t="us").groupBy("rec", F.floor(F.col("us") / 86400000000).alias("win")).agg(F.count_if("extra").alias("n_extra"))
    return rounded(f.groupBy("rec").agg(F.count(F.lit(1)).alias("windows"), F.avg("n_extra").alias("extra_per_window")))


@query("mixed_rollup", """SELECT l_returnflag AS variant, round(avg(l_quantity), 6) AS mean_quantity, round(median(l_discount), 6) AS median_discount, round(sum(l_quantity), 2) AS quantity,
  count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax >= 0.05) AS over, count(*) AS n FROM lineitem GROUP BY 1""")
def mixed_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "variant")
    out = rows.groupBy("variant").agg(F.avg("l_quantity").alias("mean_quantity"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_tax") >= 0.05).alias("over"), F.count(F.lit(1)).alias("n"))
    out = out.join(metrics.quantiles(rows, "l_discount", [0.5], "variant").select("variant", F.col("q")[0].alias("median_discount")), "variant")
    return rounded(out)



@query("subject_rates", f"""WITH {BEATS}, s AS (SELECT rec, bool_or(symbol = 'signup' AND v > 60) AS y, avg(v / 20) AS p FROM beats GROUP BY rec)
  SELECT count(*) AS subjects, round(count(*) FILTER (WHERE y AND p >= 0.5) / greatest(count(*) FILTER (WHERE y), 1), 6) AS sensitivity,
  round(count(*) FILTER (WHERE NOT y AND p < 0.5) / greatest(count(*) FILTER (WHERE NOT y), 1), 6) AS specificity FROM s""")
def subject_rates(spark, sf_dir):
    b = beats(spark, sf_dir).select("rec", ((F.col("symbol") == "signup") & (F.col("v") > 60)).alias("y"), (F.col("v") / 20).alias("p"))
    return rounded(reports.subject_rates(b, "y", "p"))
