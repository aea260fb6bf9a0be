"""Queries of aligned references, poses, rates in windows and the whole analysis, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsespark.operators import alignment, analysis, metrics, windows
from pulsespark.plans.catalog import CLEAN, SAMPLES, clean, query, rounded, samples
from pulsespark.plans.windows import REMOVAL, event_windows
from pulsespark.settings import HR_LIMITS
from pulsespark.sources.tables import signals as packed
from pulsespark.sources.tables import table

FS = 30.0
FRAMES = 90


@query("aligned_reference", f"""WITH {SAMPLES}, l AS (SELECT vec_id AS rec, embedding::DOUBLE[] AS v FROM embeddings),
  f AS (SELECT rec, f, CASE rec % 3 WHEN 0 THEN 2 * f / 7.0::DOUBLE WHEN 1 THEN f::DOUBLE ELSE f * 63 / 89.0::DOUBLE END AS x, v FROM l, range(0, {FRAMES}) r(f) WHERE rec % 3 <> 1 OR f < 64),
  p AS (SELECT *, least(greatest(x, 0), 63) AS y FROM f), q AS (SELECT *, floor(y)::INT AS lo FROM p)
  SELECT rec, f::BIGINT AS frame, round(v[lo + 1] + (v[least(lo + 1, 63) + 1] - v[lo + 1]) * (y - lo), 5) + 0.0 AS v FROM q""")
def aligned_reference(spark, sf_dir):
    """Packed signals as references: by time for one record in three, sample by sample for the next, stretched for the last."""
    s = samples(spark, sf_dir).select("rec", "i", F.when(F.col("rec") % 3 == 0, F.col("i") / 10.0).alias("t"), "v")
    r = packed(spark, sf_dir).select("rec", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame")).where(f"rec % 3 <> 1 OR frame < {64}")
    frames = r.withColumn("t", F.when(F.col("rec") % 3 == 0, F.col("frame") / 35.0))
    return alignment.to_frames(s, frames).select("rec", "frame", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("reference_sign_lag", f"""WITH {SAMPLES}, x AS (SELECT rec, i, v FROM samples), y AS (SELECT rec - 1 AS rec, i, v AS w FROM samples),
  c AS (SELECT x.rec, lag, corr(v, w) AS c FROM x, range(-5, 6) l(lag) JOIN y ON y.rec = x.rec AND y.i = x.i + lag GROUP BY x.rec, lag),
  b AS (SELECT rec, arg_max(lag, round(abs(c), 9) * 1000 - lag / 1e9) AS lag FROM c GROUP BY rec), s AS (SELECT b.rec, b.lag, CASE WHEN c < 0 THEN -1 ELSE 1 END AS sign FROM b JOIN c ON c.rec = b.rec AND c.lag = b.lag)
  SELECT x.rec, (i + lag + 64) % 64 AS i, round(v * sign, 6) AS v, lag, sign FROM x JOIN s ON s.rec = x.rec""")
def reference_sign_lag(spark, sf_dir):
    """Each signal shifted and signed to match the next one."""
    s = samples(spark, sf_dir)
    other = s.select((F.col("rec") - 1).alias("rec"), "i", F.col("v").alias("y"))
    a = alignment.aligned(s.select("rec", "i", F.col("v").alias("x")).join(other, ["rec", "i"]), 5)
    return rounded(a.select("rec", F.col("i").cast("long").alias("i"), "v", F.col("lag").cast("long").alias("lag"), "sign"))


@query("pose_from_matrix", """WITH m AS (SELECT vec_id AS rec, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, sqrt(e[1] * e[1] + e[5] * e[5] + e[9] * e[9]) AS a, sqrt(e[2] * e[2] + e[6] * e[6] + e[10] * e[10]) AS b, sqrt(e[3] * e[3] + e[7] * e[7] + e[11] * e[11]) AS c FROM m)
  SELECT rec, round(degrees(asin(greatest(-1, least(1, -e[9] / a)))), 5) AS yaw, round(degrees(atan2(e[10] / b, e[11] / c)), 5) AS pitch, round(degrees(atan2(e[5] / a, e[1] / a)), 5) AS roll, round(e[4], 6) AS x, round(e[8], 6) AS y, round(e[12], 6) AS z FROM n""")
def pose_from_matrix(spark, sf_dir):
    """The first twelve values of a signal as three rows of a transformation."""
    made = analysis.pose_from_matrix([F.col("values")[k] for k in range(12)])
    names = ["yaw", "pitch", "roll", "x", "y", "z"]
    return packed(spark, sf_dir).select("rec", *[F.round(c, 5 if n in names[:3] else 6).alias(n) for n, c in zip(names, made, strict=True)])


@query("window_rates", f"""WITH {SAMPLES}, c AS (SELECT unnest([0.2, 1.0, 2.1])::DOUBLE AS centre_s), w AS (SELECT rec, centre_s, i - greatest(0, least(32, round_even(centre_s * 30 - 16, 0)::INT)) AS j, v FROM samples, c WHERE i >= greatest(0, least(32, round_even(centre_s * 30 - 16, 0)::INT)) AND i < greatest(0, least(32, round_even(centre_s * 30 - 16, 0)::INT)) + 32),
  p AS (SELECT rec, centre_s, k, sum(v * cos(2 * pi() * k * j / 32768)) ^ 2 + sum(v * sin(2 * pi() * k * j / 32768)) ^ 2 AS p FROM w, range(547, 3605) r(k) GROUP BY 1, 2, 3)
  SELECT rec, centre_s, round(60 * arg_max(k, p) * (30.0::DOUBLE / 32768), 4) AS rate FROM p GROUP BY 1, 2""")
def window_rates(spark, sf_dir):
    """Rates of the packed signals in windows around three places."""
    s = packed(spark, sf_dir)
    centres = s.select("rec", F.explode(F.array(*[F.lit(c) for c in (0.2, 1.0, 2.1)])).alias("centre_s"))
    return rounded(analysis.window_rates(s, centres, FS, 32), 4)


@query("flagged_share_by_window", f"{REMOVAL} SELECT rec, win, any_value(rec % 3 = 0) AS af, any_value(beats) AS beats, bool_or(symbol = 'error') AS premature, round(count(*) FILTER (WHERE hit) / any_value(beats)::DOUBLE, 6) AS flagged_share FROM hits GROUP BY rec, win HAVING any_value(beats) >= 12")
def flagged_share_by_window(spark, sf_dir):
    """Share of each window's beats that are extra, windows of twelve beats or more."""
    return rounded(windows.flagged_shares(event_windows(spark, sf_dir)).select("rec", "win", "af", "beats", "premature", "flagged_share"))


@query("hr_flag_report", f"""WITH {CLEAN}, s AS (SELECT rec, floor(us / 3.6e10 / 10) AS seg, count(*) AS n, 60 / median(ibi) AS ref, 60 / median(ibi) FILTER (WHERE symbol <> 'error') AS pred, count(*) FILTER (WHERE symbol <> 'error') AS m FROM clean GROUP BY 1, 2),
  f AS (SELECT CASE WHEN n >= 4 THEN ref END AS ref, CASE WHEN m >= 4 THEN pred END AS pred FROM s), g AS (SELECT *, CASE WHEN ref IS NULL THEN 'insufficient' WHEN ref < 50 THEN 'slow' WHEN ref > 100 THEN 'fast' ELSE 'normal' END AS a, CASE WHEN pred IS NULL THEN 'insufficient' WHEN pred < 50 THEN 'slow' WHEN pred > 100 THEN 'fast' ELSE 'normal' END AS b FROM f),
  ok AS (SELECT * FROM g WHERE a <> 'insufficient' AND b <> 'insufficient'), t AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS acc, avg(abs(pred - ref)) AS mae FROM ok), e AS (SELECT sum(x.n * y.n) / any_value(t.n * t.n) AS pe FROM (SELECT a AS k, count(*) AS n FROM ok GROUP BY 1) x JOIN (SELECT b AS k, count(*) AS n FROM ok GROUP BY 1) y USING (k), t)
  SELECT (SELECT count(*) FROM g) AS segments, n::BIGINT AS scored, round(n / (SELECT count(*) FROM g), 6) AS coverage, round(acc, 6) AS accuracy, round((acc - pe) / (1 - pe), 6) AS kappa, round(mae, 5) AS hr_mae FROM t, e""")
def hr_flag_report(spark, sf_dir):
    """Slow and fast flags of segments of ten units from beats without errors, held against those of all beats."""
    c = clean(spark, sf_dir)
    some = F.col("symbol") != "error"
    g = c.groupBy("rec", F.floor(F.col("us") / 3.6e10 / 10).alias("seg")).agg(F.count(F.lit(1)).alias("n"), (60 / F.median("ibi")).alias("ref"), (60 / F.median(F.when(some, F.col("ibi")))).alias("pred"), F.count_if(some).alias("m"))
    s = g.select(F.when(F.col("n") >= 4, F.col("ref")).alias("ref"), F.when(F.col("m") >= 4, F.col("pred")).alias("pred"))
    r = metrics.flag_report(s, "ref", "pred", HR_LIMITS)
    return r.select("segments", "scored", *[F.round(c, 6).alias(c) for c in ("coverage", "accuracy", "kappa")], F.round("hr_mae", 5).alias("hr_mae"))


@query("analysed_records")
def analysed_records(spark, sf_dir):
    """The whole analysis of embeddings as patches of a record (their label), by all parts of the fusion; tests hold it
    against synthetic faces."""
    s = samples(spark, sf_dir).select(F.col("label").cast("long").alias("rec"), F.col("rec").alias("patch"), F.col("i").cast("long").alias("i"), (100 + 5 * F.col("v")).alias("r"), (100 - 5 * F.col("v")).alias("g"), (100 + F.col("v")).alias("b"), F.lit(400.0).alias("n_px"), F.lit(0.9).alias("facing"))
    pose = s.groupBy("rec", "i").agg(F.avg("r").alias("yaw"), F.avg("b").alias("pitch"))
    a = analysis.analyse(s, FS, "full", pose, ["yaw", "pitch"], length_s=1.6, step_s=0.4)
    return rounded(a.records.select("rec", "rate", F.size("beats").alias("n_beats"), "confidence", "n_windows"), 3)


@query("heart_rate_summary", """WITH x AS (SELECT l_returnflag AS grp, l_quantity + 50.0::DOUBLE AS ref, l_linestatus = 'O' AS irregular, l_quantity + l_discount * 200.0::DOUBLE + 45 AS fft, CASE WHEN l_tax > 0.01 THEN l_quantity + l_tax * 300.0::DOUBLE + 40 END AS beats FROM lineitem)
  SELECT CASE WHEN grouping(grp) = 1 THEN 'all' ELSE grp END AS grp, count(*) AS n, round(avg(irregular::INT), 6) AS irregular_share, round(avg(abs(fft - ref)), 5) AS fft_mae, round(count(*) FILTER (WHERE abs(fft - ref) > 10) / count(fft)::DOUBLE, 6) AS fft_over,
    round(avg(abs(beats - ref)), 5) AS beats_mae, round(count(*) FILTER (WHERE abs(beats - ref) > 10) / count(beats)::DOUBLE, 6) AS beats_over FROM x GROUP BY ROLLUP (grp)""")
def heart_rate_summary(spark, sf_dir):
    """Errors of two ways to a rate per group and over all; columns of lineitem stand for windows' rates."""
    q = F.col("l_quantity")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (q + 50.0).alias("ref"), (F.col("l_linestatus") == "O").alias("irregular"), (q + F.col("l_discount") * 200.0 + 45).alias("fft"), F.when(F.col("l_tax") > 0.01, q + F.col("l_tax") * 300.0 + 40).alias("beats"))
    r = metrics.error_report(l, ["fft", "beats"], "ref", "grp", irregular="irregular")
    return r.select("grp", "n", *[F.round(c, 5 if c.endswith("mae") else 6).alias(c) for c in ("irregular_share", "fft_mae", "fft_over", "beats_mae", "beats_over")])


@query("variant_summary", """SELECT l_returnflag AS variant, l_linestatus AS refine, count(*) AS n, round(avg(l_quantity), 5) AS l_quantity, round(avg(CASE WHEN l_discount > 0.02 THEN l_discount END), 7) AS error, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1, 2""")
def variant_summary(spark, sf_dir):
    """Means and totals of a variant and refinement; columns of lineitem stand for scores of recordings, some without a reference."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("refine"), "l_quantity", F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("error"), "l_tax")
    r = metrics.variant_report(l, ["variant", "refine"], ["l_quantity", "error"], ["l_tax"])
    return r.select("variant", "refine", "n", F.round("l_quantity", 5).alias("l_quantity"), F.round("error", 7).alias("error"), F.round("l_tax", 4).alias("l_tax"))
