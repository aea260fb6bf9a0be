"""Queries of windowed fusion, agreement of beats and motion removal, and their SQL.

Embeddings of a label are the patches of a record; the means of its even and odd patches stand for two channels of pose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsespark.operators import fusion
from pulsespark.plans.catalog import BEATS, SAMPLES, query, rounded, samples
from pulsespark.settings import BEAT_TOLERANCE
from pulsespark.sources.tables import UNIT, beats

FS, LENGTH, STEP, APART = 30.0, 32, 12, 0.11
CHANNELS = ["x1", "x2"]
#: Two sorted lists (id, a, b): places in both, moved on as greedy one-to-one matching does.
WALK = """walk AS (SELECT id, 1 AS i, 1 AS j, 0 AS n FROM lists UNION ALL
  SELECT w.id, i + CASE WHEN abs(a[i] - b[j]) <= {apart} OR a[i] < b[j] THEN 1 ELSE 0 END, j + CASE WHEN abs(a[i] - b[j]) <= {apart} OR a[i] >= b[j] THEN 1 ELSE 0 END, n + CASE WHEN abs(a[i] - b[j]) <= {apart} THEN 1 ELSE 0 END
  FROM walk w JOIN lists l ON l.id = w.id WHERE i <= len(a) AND j <= len(b)), matched AS (SELECT id, max(n) AS n FROM walk GROUP BY id)"""


@query("beat_match_f1", f"""WITH RECURSIVE {BEATS}, lists AS (SELECT rec AS id, coalesce(list(us / 3.6e10 ORDER BY us) FILTER (WHERE symbol = 'click'), []) AS a, coalesce(list(us / 3.6e10 ORDER BY us) FILTER (WHERE symbol = 'error'), []) AS b FROM beats WHERE symbol IN ('click', 'error') GROUP BY rec),
  {WALK.format(apart=BEAT_TOLERANCE)} SELECT id AS rec, len(a) AS a, len(b) AS b, n::BIGINT AS matches, round(2.0 * n / (len(a) + len(b)), 6) AS f1 FROM lists JOIN matched USING (id)""")
def beat_match_f1(spark, sf_dir):
    """Greedy one-to-one matches of clicks and errors within a tolerance."""
    b = beats(spark, sf_dir).where("symbol IN ('click', 'error')").select("rec", (F.col("us") / UNIT).alias("t"), (F.col("symbol") == "error").cast("int").alias("side"))
    return rounded(fusion.matches(b, BEAT_TOLERANCE, "rec"))


SEGMENTS = f"""{SAMPLES}, st AS (SELECT unnest([0, 12, 24, 32]) AS start),
  seg AS (SELECT label AS rec, rec AS patch, start, i, v / stddev_pop(v) OVER (PARTITION BY rec, start) AS x FROM samples JOIN st ON i >= start AND i < start + 32),
  tot AS (SELECT *, sum(x) OVER (PARTITION BY rec, start, i) / count(*) OVER (PARTITION BY rec, start, i) AS total, count(*) OVER (PARTITION BY rec, start, i) AS p FROM seg),
  con AS (SELECT rec, start, patch, any_value(p) AS p, greatest(0, least(1, corr(x, total - x / p))) AS c FROM tot GROUP BY 1, 2, 3),
  w1 AS (SELECT *, c * c / sum(c * c) OVER (PARTITION BY rec, start) AS w FROM con),
  two AS (SELECT s.*, w.w, sum(w.w * s.x) OVER (PARTITION BY s.rec, s.start, s.i) - w.w * s.x AS other FROM seg s JOIN w1 w USING (rec, start, patch)),
  tops AS (SELECT *, x > lag(x) OVER q AND x >= lead(x) OVER q AS own, other > lag(other) OVER q AND other >= lead(other) OVER q AS theirs FROM two WINDOW q AS (PARTITION BY rec, start, patch ORDER BY i)),
  lists AS (SELECT (rec, start, patch) AS id, coalesce(list((i - start) / 30.0::DOUBLE ORDER BY i) FILTER (WHERE own), []) AS a, coalesce(list((i - start) / 30.0::DOUBLE ORDER BY i) FILTER (WHERE theirs), []) AS b FROM tops GROUP BY rec, start, patch),
  {WALK.format(apart=APART)},
  agree AS (SELECT id, 2.0 * n / greatest(len(a) + len(b), 1) AS f FROM lists JOIN matched USING (id)),
  raw AS (SELECT w1.*, f, w * f AS g FROM w1 JOIN agree ON agree.id = (rec, start, patch)),
  wts AS (SELECT *, g / sum(g) OVER (PARTITION BY rec, start) AS weight FROM raw)"""


def windows_fused(spark, sf_dir):
    s = samples(spark, sf_dir).select(F.col("label").alias("rec"), F.col("rec").alias("patch"), "i", "v")
    return fusion.fuse_windows(s, FS, LENGTH, STEP, APART, find=lambda x: fusion.maxima(x) / FS)


def pose(spark, sf_dir):
    """Two channels for each record and sample."""
    mean = lambda k: F.avg(F.when(F.col("rec") % 2 == k, F.col("v")))
    return samples(spark, sf_dir).groupBy(F.col("label").alias("rec"), F.col("i").cast("long").alias("i")).agg(mean(0).alias("x1"), mean(1).alias("x2"))


@query("beat_agreement_scores", f"""WITH RECURSIVE {SEGMENTS} SELECT rec, start, patch, round(weight, 6) AS weight, round(c, 6) AS consistency, round(f, 6) AS agreement FROM wts""")
def beat_agreement_scores(spark, sf_dir):
    """Weight, consistency and agreement of each patch in each window; local maxima stand for beats."""
    w = windows_fused(spark, sf_dir)
    each = F.explode(F.arrays_zip("patches", "weights", "consistency", "agreement"))
    return rounded(w.select("rec", "start", each.alias("p")).select("rec", "start", F.col("p.patches").alias("patch"), F.col("p.weights").alias("weight"), "p.consistency", "p.agreement"))


POSE = """pose AS (SELECT label AS rec, i, avg(v) FILTER (WHERE rec % 2 = 0) AS x1, avg(v) FILTER (WHERE rec % 2 = 1) AS x2 FROM samples GROUP BY 1, 2),
  slope AS (SELECT rec, i, sqrt(pow(30 * CASE WHEN lag(x1) OVER q IS NULL THEN lead(x1) OVER q - x1 WHEN lead(x1) OVER q IS NULL THEN x1 - lag(x1) OVER q ELSE (lead(x1) OVER q - lag(x1) OVER q) / 2 END, 2)
    + pow(30 * CASE WHEN lag(x2) OVER q IS NULL THEN lead(x2) OVER q - x2 WHEN lead(x2) OVER q IS NULL THEN x2 - lag(x2) OVER q ELSE (lead(x2) OVER q - lag(x2) OVER q) / 2 END, 2)) AS speed FROM pose WINDOW q AS (PARTITION BY rec ORDER BY i)),
  calm AS (SELECT rec, start, 1 / (1 + pow(avg(speed) / 5, 2)) AS still FROM slope JOIN st ON i >= start AND i < start + 32 GROUP BY 1, 2)"""
FUSED = f"""{SEGMENTS}, {POSE}, fused AS (SELECT rec, start, i, sum(weight * x) AS y FROM seg JOIN wts USING (rec, start, patch) GROUP BY 1, 2, 3),
  z AS (SELECT f.*, (x1 - avg(x1) OVER q) / stddev_pop(x1) OVER q AS z1, (x2 - avg(x2) OVER q) / stddev_pop(x2) OVER q AS z2 FROM fused f JOIN pose USING (rec, i) WINDOW q AS (PARTITION BY rec, start)),
  fit AS (SELECT rec, start, avg(z1 * z2) AS r, avg(z1 * y) AS b1, avg(z2 * y) AS b2 FROM z GROUP BY 1, 2),
  clean AS (SELECT z.rec, z.start, i, y - z1 * (1.1 * b1 - r * b2) / (1.21 - r * r) - z2 * (1.1 * b2 - r * b1) / (1.21 - r * r) AS y FROM z JOIN fit USING (rec, start))"""


@query("fused_window_confidence", f"""WITH RECURSIVE {SEGMENTS}, {POSE}, n AS (SELECT rec, start, sum(weight * c) AS agreed, least(1, 1 / sum(weight * weight) / greatest(1, 0.3 * count(*))) AS coverage FROM wts GROUP BY 1, 2)
  SELECT rec, start, round(agreed, 6) AS agreed, round(coverage, 6) AS coverage, round(still, 6) AS still, round(pow(agreed * coverage * still, 1.0 / 3), 6) AS confidence FROM n JOIN calm USING (rec, start)""")
def fused_window_confidence(spark, sf_dir):
    """Confidence of each window from consistency, enough patches and a still head (beat shape has tests only)."""
    c = windows_fused(spark, sf_dir).select("rec", "start", "agreed", "coverage").join(fusion.stillness(pose(spark, sf_dir), FS, CHANNELS, LENGTH, STEP), ["rec", "start"])
    return rounded(c.select("rec", "start", "agreed", "coverage", "still", fusion.confidence(F.col("agreed"), F.col("coverage"), F.col("still")).alias("confidence")))


@query("fused_pulse_confidence", f"""WITH RECURSIVE {FUSED}, h AS (SELECT rec, i, y, 0.5 - 0.5 * cos(2 * pi() * (i - start + 1) / 33) AS h FROM clean)
  SELECT rec, i::BIGINT AS i, round(sum(y * h) / greatest(sum(h), 1e-9), 5) + 0.0 AS fused FROM h GROUP BY 1, 2""")
def fused_pulse_confidence(spark, sf_dir):
    """The pulse fused in windows by consistency and agreement, less what the pose explains in each, overlap-added."""
    w = windows_fused(spark, sf_dir)
    f = w.select("rec", "start", F.size("fused").alias("length"), F.posexplode("fused").alias("k", "v")).withColumn("i", F.col("start") + F.col("k"))
    clean = fusion.remove_explained(f.join(pose(spark, sf_dir), ["rec", "i"]), ["v"], CHANNELS, "rec", "start")
    out = fusion.overlap_add(clean.select("rec", "start", "i", "length", "v"))
    return out.select("rec", "i", (F.round("v", 5) + F.lit(0.0)).alias("fused"))
