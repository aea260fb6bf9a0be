"""Queries of breathing and of the choice of a level, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsespark.operators import breathing, spectra, trust
from pulsespark.plans.catalog import SAMPLES, query, rounded, samples
from pulsespark.sources.tables import signals as packed
from pulsespark.sources.tables import table

FS = 30.0
PEAKS = SAMPLES + ", near AS (SELECT rec, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM samples WINDOW w AS (PARTITION BY rec ORDER BY i)), peaks AS (SELECT rec, i, v, lag(i) OVER (PARTITION BY rec ORDER BY i) AS prev, count(*) OVER (PARTITION BY rec) AS n FROM near WHERE v > a AND v >= b)"


@query("breath_modulations", f"""WITH {PEAKS}, feet AS (SELECT p.rec, p.i, any_value(p.v) AS high, any_value(p.prev) AS prev, min(s.v) AS low FROM peaks p JOIN samples s ON s.rec = p.rec AND s.i BETWEEN coalesce(p.prev, greatest(0, p.i - 30)) AND p.i WHERE p.n >= 4 GROUP BY p.rec, p.i),
  m AS (SELECT rec, 'RIAV' AS name, i / 30.0::DOUBLE AS t, high - low AS v FROM feet UNION ALL SELECT rec, 'RIIV', i / 30.0::DOUBLE, low FROM feet UNION ALL SELECT rec, 'RIFV', i / 30.0::DOUBLE, (i - prev) / 30.0::DOUBLE FROM feet WHERE prev IS NOT NULL)
  SELECT rec, name, round(t, 6) AS t, round(v, 6) AS v FROM m""")
def breath_modulations(spark, sf_dir):
    """Peaks of the packed signals stand for beats."""
    w = Window.partitionBy("rec").orderBy("i")
    s = samples(spark, sf_dir).withColumn("peak", F.coalesce((F.col("v") > F.lag("v").over(w)) & (F.col("v") >= F.lead("v").over(w)), F.lit(False)))
    return rounded(breathing.modulations(s.select("rec", "i", "v", "peak"), FS))


@query("breathing_fusion", """WITH x AS (SELECT l_orderkey AS rec, l_linenumber AS win, list_filter([l_quantity::DOUBLE / 3, CASE WHEN l_returnflag <> 'R' THEN l_discount::DOUBLE * 100 END, l_tax::DOUBLE * 100], lambda v: v IS NOT NULL) AS e FROM lineitem),
  y AS (SELECT *, list_sum(e) / len(e) AS m FROM x) SELECT rec, win, round(CASE WHEN round(list_sum(list_transform(e, lambda v: (v - m) * (v - m))) / len(e), 9) <= 16 THEN m END, 6) AS rate FROM y""")
def breathing_fusion(spark, sf_dir):
    """Three columns of lineitem stand for a window's estimates by modulation, returned lines for irregular windows."""
    e = {"RIAV": F.col("l_quantity") / 3, "RIFV": F.col("l_discount") * 100, "RIIV": F.col("l_tax") * 100}
    return rounded(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("win"), breathing.fuse_estimates(e, F.col("l_returnflag") == "R").alias("rate")))


@query("breath_count_agreement", f"""WITH {SAMPLES}, u AS (SELECT rec, i, v, lag(v) OVER (PARTITION BY rec ORDER BY i) AS a FROM samples), g AS (SELECT rec, count(*) FILTER (WHERE a < 0 AND v >= 0) AS crossings, min(i) FILTER (WHERE a < 0 AND v >= 0) AS lo, max(i) FILTER (WHERE a < 0 AND v >= 0) AS hi FROM u GROUP BY rec),
  c AS (SELECT rec, crossings, CASE WHEN crossings >= 3 THEN 60.0::DOUBLE * (crossings - 1) / ((hi - lo) / 30.0::DOUBLE) END AS counted FROM g), m AS (SELECT rec, i, v - avg(v) OVER (PARTITION BY rec) AS v FROM samples),
  p AS (SELECT rec, k, sum(v * cos(k * (2 * pi() / 64) * i)) ^ 2 + sum(v * sin(k * (2 * pi() / 64) * i)) ^ 2 AS power FROM m, range(1, 32) r(k) GROUP BY rec, k), s AS (SELECT rec, arg_max(k, power) * (30.0::DOUBLE / 64 * 60) AS spectral FROM p GROUP BY rec)
  SELECT rec, crossings, round(counted, 6) AS counted, round(spectral, 5) AS spectral, CASE WHEN abs(spectral - counted) <= 60 THEN round(spectral, 5) END AS agreed FROM c JOIN s USING (rec)""")
def breath_count_agreement(spark, sf_dir):
    """Crossings of the packed signals, held against their strongest frequency."""
    power = spectra.dft_power(packed(spark, sf_dir), list(range(1, 32)), 64)
    spectral = power.groupBy("rec").agg((F.max_by("bin", F.struct("power", -F.col("bin"))) * (FS / 64 * 60)).alias("spectral"))
    c = breathing.counted_rate(samples(spark, sf_dir), FS).join(spectral, "rec")
    return rounded(c.select("rec", "crossings", "counted", F.round("spectral", 5).alias("spectral"), F.round(breathing.agreed(F.col("spectral"), F.col("counted"), 60.0), 5).alias("agreed")))


#: A sample a second, so that a signal is a minute long and its peaks are slow enough to carry breathing.
SLOW = 1.0


@query("breath_rates", f"""WITH {PEAKS}, feet AS (SELECT p.rec, p.i, any_value(p.v) AS high, any_value(p.prev) AS prev, min(s.v) AS low FROM peaks p JOIN samples s ON s.rec = p.rec AND s.i BETWEEN coalesce(p.prev, greatest(0, p.i - 1)) AND p.i WHERE p.n >= 4 GROUP BY p.rec, p.i),
  m AS (SELECT rec, 'RIAV' AS name, i::DOUBLE AS t, high - low AS v FROM feet UNION ALL SELECT rec, 'RIIV', i::DOUBLE, low FROM feet UNION ALL SELECT rec, 'RIFV', i::DOUBLE, (i - prev)::DOUBLE FROM feet WHERE prev IS NOT NULL),
  ok AS (SELECT rec, name, min(t) AS t0, max(t) AS t1 FROM m GROUP BY 1, 2 HAVING count(*) >= 6 AND stddev_pop(v) > 0 AND max(t) - min(t) >= 0.6 * 64),
  seg AS (SELECT m.*, t0, t1, lead(t) OVER w AS tn, lead(v) OVER w AS vn FROM m JOIN ok USING (rec, name) WINDOW w AS (PARTITION BY rec, name ORDER BY t)),
  grid AS (SELECT rec, name, g, v + (vn - v) * ((t0 + g / 4.0::DOUBLE - t) / (tn - t)) AS y FROM seg, range(0, 256) r(g) WHERE t0 + g / 4.0::DOUBLE >= t AND t0 + g / 4.0::DOUBLE < tn),
  flat AS (SELECT rec, name, g, y - avg(y) OVER q - regr_slope(y, g) OVER q * (g - avg(g) OVER q) AS y FROM grid WINDOW q AS (PARTITION BY rec, name)),
  f AS (SELECT k, k * 4.0::DOUBLE / 1024 AS f, 8 * tan(pi() * k / 1024) AS w, 8 * tan(pi() * 0.1 / 4) AS lo, 8 * tan(pi() * 0.6 / 4) AS hi FROM range(26, 154) r(k)),
  gain AS (SELECT k, f, pow(1 + pow((w * w - lo * hi) / (w * (hi - lo)), 4), -2) AS h FROM f),
  p AS (SELECT rec, name, k, any_value(f) AS f, any_value(h) * (sum(y * cos(2 * pi() * k * g / 1024)) ^ 2 + sum(y * sin(2 * pi() * k * g / 1024)) ^ 2) AS p FROM flat, gain GROUP BY 1, 2, 3),
  r AS (SELECT rec, name, 60 * arg_max(f, p) AS rate FROM p GROUP BY 1, 2), w AS (SELECT rec, max(rate) FILTER (WHERE name = 'RIAV') AS a, max(rate) FILTER (WHERE name = 'RIFV') AS b, max(rate) FILTER (WHERE name = 'RIIV') AS c FROM r GROUP BY rec),
  e AS (SELECT *, list_filter([a, CASE WHEN rec % 5 <> 0 THEN b END, c], lambda z: z IS NOT NULL) AS e FROM w)
  SELECT rec, round(a, 5) AS riav, round(b, 5) AS rifv, round(c, 5) AS riiv, CASE WHEN len(e) > 0 AND round(list_sum(list_transform(e, lambda z: pow(z - list_sum(e) / len(e), 2))) / len(e), 9) <= 16 THEN round(list_sum(e) / len(e), 5) END AS fused FROM e""")
def breath_rates(spark, sf_dir):
    """Breathing rates of the packed signals by each modulation of their peaks, and fused; every fifth counts as irregular."""
    w = Window.partitionBy("rec").orderBy("i")
    s = samples(spark, sf_dir).withColumn("peak", F.coalesce((F.col("v") > F.lag("v").over(w)) & (F.col("v") >= F.lead("v").over(w)), F.lit(False)))
    rates = breathing.series_rates(breathing.modulations(s.select("rec", "i", "v", "peak"), SLOW), 64 / SLOW, "rec", "name")
    one = lambda k: F.max(F.when(F.col("name") == k, F.col("rate")))
    r = rates.where("rate IS NOT NULL").groupBy("rec").agg(one("RIAV").alias("riav"), one("RIFV").alias("rifv"), one("RIIV").alias("riiv"))
    return rounded(r.withColumn("fused", breathing.fuse_estimates({"RIAV": F.col("riav"), "RIFV": F.col("rifv"), "RIIV": F.col("riiv")}, F.col("rec") % 5 == 0)), 5)


@query("breathing_aware_rate", f"""WITH {SAMPLES}, p AS (SELECT rec, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(k * (2 * pi() / 256) * i)) ^ 2 + sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(k * (2 * pi() / 256) * i)) ^ 2 AS p,
    sum(v * cos(k * (2 * pi() / 256) * i)) ^ 2 + sum(v * sin(k * (2 * pi() / 256) * i)) ^ 2 AS plain FROM samples, range(5, 29) r(k) GROUP BY rec, k),
  l AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS b, max(p) OVER (PARTITION BY rec) AS most FROM p WINDOW w AS (PARTITION BY rec ORDER BY k)), top AS (SELECT rec, k, p, most FROM l WHERE p > a AND p > b),
  e AS (SELECT t.rec, t.k, t.p, t.most, max(p.k) FILTER (WHERE p.k < t.k AND p.p > t.p) AS lo, min(p.k) FILTER (WHERE p.k > t.k AND p.p > t.p) AS hi FROM top t JOIN p USING (rec) GROUP BY ALL),
  m AS (SELECT e.rec, e.k, e.p, e.most, min(p.p) FILTER (WHERE p.k <= e.k AND p.k > coalesce(lo, 0)) AS l, min(p.p) FILTER (WHERE p.k >= e.k AND p.k < coalesce(hi, 99)) AS r FROM e JOIN p USING (rec) GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, k DESC) AS n FROM m WHERE p - greatest(l, r) >= 0.05 * most), free AS (SELECT rec, arg_min(k, n) AS k FROM best WHERE n <= 5 AND rec % 7 <> 0 AND list_bool_and([abs(k * 7.03125 - x * (10 + rec % 40)) > 3 for x in [1, 2, 3]]) GROUP BY rec),
  usual AS (SELECT rec, arg_max(k, plain) AS k FROM p GROUP BY rec) SELECT u.rec, round(u.k * 7.03125::DOUBLE, 5) AS rate, round(coalesce(f.k, u.k) * 7.03125::DOUBLE, 5) AS aware FROM usual u LEFT JOIN free f USING (rec)""")
def breathing_aware_rate(spark, sf_dir):
    """Rates of the packed signals that keep clear of a breathing rate (10 to 49 a minute by record; unknown for every seventh)."""
    s, bins = packed(spark, sf_dir), list(range(5, 29))
    known = s.select("rec", F.when(F.col("rec") % 7 != 0, (10 + F.col("rec") % 40).cast("double")).alias("breathing"))
    return rounded(spectra.rate_beside_breathing(spectra.dft_power(s, bins, 256, hann=True, centre=False), spectra.dft_power(s, bins, 256, centre=False), known, FS, 256), 5)


METHODS = {"narrow": ["hr_RIAV", "hr_RIFV"], "wide": ["wide_RIAV", "wide_RIFV", "wide_RIIV"], "amplitude": ["wide_RIAV"]}
ONE = "CASE WHEN len({e}) > 0 AND round(list_sum(list_transform({e}, lambda z: pow(z - list_sum({e}) / len({e}), 2))) / len({e}), 9) <= pow({sd}, 2) THEN abs(list_sum({e}) / len({e}) - ref) END"


@query("breathing_summary", f"""WITH x AS (SELECT l_returnflag AS grp, l_quantity / 2.0::DOUBLE AS ref, l_linestatus = 'O' AS irregular, l_discount * 250.0::DOUBLE AS a, l_tax * 250.0::DOUBLE AS b, l_partkey % 26 * 1.0::DOUBLE AS c FROM lineitem),
  y AS (SELECT *, CASE WHEN irregular THEN [a] ELSE [a, b] END AS narrow, CASE WHEN irregular THEN [b, c] ELSE [b, a, c] END AS wide, [b] AS amplitude FROM x),
  z AS ({" UNION ALL ".join(f"SELECT grp, '{m}' AS method, {sd}.0::DOUBLE AS max_sd, {ONE.format(e=m, sd=sd)} AS e FROM y" for m in METHODS for sd in (2, 4))})
  SELECT grp, method, max_sd, count(*) AS windows, round(count(e) / count(*)::DOUBLE, 6) AS coverage, round(avg(e), 6) AS mae, round(count(*) FILTER (WHERE e <= 2) / count(e)::DOUBLE, 6) AS within_2 FROM z GROUP BY 1, 2, 3""")
def breathing_summary(spark, sf_dir):
    """Columns of lineitem stand for windows' estimates and references; open lines for irregular windows."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_quantity") / 2.0).alias("ref"), (F.col("l_linestatus") == "O").alias("irregular"), (F.col("l_discount") * 250.0).alias("hr_RIAV"), (F.col("l_tax") * 250.0).alias("hr_RIFV"),
        (F.col("l_tax") * 250.0).alias("wide_RIAV"), (F.col("l_discount") * 250.0).alias("wide_RIFV"), (F.col("l_partkey") % 26).cast("double").alias("wide_RIIV"))
    return rounded(breathing.summary(l, METHODS, [2.0, 4.0], "ref", "irregular", "grp"))


LEVELS = {7: [[k] for k in range(1, 8)], 3: [[1, 2, 3], [4, 5], [6, 7]], 2: [[1, 2, 3, 4], [5, 6, 7]]}


@query("patch_level_choice", """WITH c AS (SELECT l_orderkey % 1000 AS rec, l_orderkey AS frame, l_linenumber AS k, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY 1, 2, 3), frames AS (SELECT DISTINCT rec, frame FROM c WHERE n > 0),
  members(level, grp, k) AS (SELECT 7, x, x FROM range(1, 8) r(x) UNION ALL SELECT 3, CASE WHEN x <= 3 THEN 1 WHEN x <= 5 THEN 2 ELSE 3 END, x FROM range(1, 8) r(x)),
  sizes AS (SELECT f.rec, f.frame, level, grp, coalesce(sum(n), 0) AS n FROM frames f CROSS JOIN members m LEFT JOIN c ON c.rec = f.rec AND c.frame = f.frame AND c.k = m.k GROUP BY 1, 2, 3, 4),
  typical AS (SELECT rec, level, median(n) AS n FROM (SELECT rec, frame, level, median(n) AS n FROM sizes GROUP BY 1, 2, 3) GROUP BY 1, 2)
  SELECT rec, coalesce(max(level) FILTER (WHERE n >= 20), 2)::INT AS level FROM typical GROUP BY rec""")
def patch_level_choice(spark, sf_dir):
    """Lines of an order stand for the patches of a frame, quantities for their pixels."""
    c = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("rec"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("patch"), F.col("l_quantity").alias("n"))
    return trust.choose_level(c, LEVELS, 20.0)
