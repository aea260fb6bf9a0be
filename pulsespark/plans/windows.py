"""Queries of window tables, removal settings and screening, and their SQL. A window is 30 units of time of the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsespark.operators import models, reports, windows
from pulsespark.plans.catalog import BEATS, query, rounded
from pulsespark.settings import IRREGULAR
from pulsespark.sources.tables import UNIT, beats
from pulsespark.streaming.monitor import shared_dir

WIDTH = 30
SETTINGS = {"cap20": (0.2, None), "cap10_tol15": (0.1, 0.15)}
IN_WINDOWS = BEATS + f""", wb AS (SELECT *, t - lag(t) OVER (PARTITION BY rec, win ORDER BY t, beat) AS ibi
  FROM (SELECT *, us / 3.6e10 AS t, floor(us / 3.6e10 / {WIDTH})::BIGINT AS win, max(us / 3.6e10) OVER (PARTITION BY rec) AS last FROM beats) WHERE (win + 1) * {WIDTH} < last)"""


def event_windows(spark, sf_dir):
    """Windows of the events' beats; `af` is a class of the record, `premature` whether an error is among the beats."""
    return windows.beat_windows(beats(spark, sf_dir), WIDTH, F.some(F.col("symbol") == "error").alias("premature"), F.every(F.col("rec") % 3 == 0).alias("af"), t=F.col("us") / UNIT)


@query("window_rows", f"""WITH {IN_WINDOWS}, cl AS (SELECT *, lag(ibi) OVER w AS prev, lead(ibi) OVER w AS next, row_number() OVER (PARTITION BY rec, win ORDER BY ibi, beat) AS k, count(*) OVER (PARTITION BY rec, win) AS n FROM wb WHERE ibi BETWEEN 0.3 AND 2.0 WINDOW w AS (PARTITION BY rec, win ORDER BY t, beat)),
  f AS (SELECT rec, win, count(*) AS n, sqrt(avg(pow(ibi - prev, 2))) / avg(ibi) AS nrmssd, CASE WHEN stddev_pop((next + ibi) / sqrt(2.0)) = 0 THEN 0.0 ELSE stddev_pop((next - ibi) / sqrt(2.0)) / stddev_pop((next + ibi) / sqrt(2.0)) END AS sd1_sd2,
    count(*) FILTER (WHERE (ibi > prev AND ibi > next) OR (ibi < prev AND ibi < next)) / greatest(count(*) - 2, 1)::DOUBLE AS tpr FROM cl GROUP BY rec, win),
  s AS (SELECT rec, win, ibi, min(ibi) OVER w AS lo, max(ibi) OVER w AS hi, count(*) OVER w AS m FROM cl WHERE n <= 32 OR (k > 8 AND k <= n - 8) WINDOW w AS (PARTITION BY rec, win)),
  h AS (SELECT rec, win, CASE WHEN hi > lo THEN least(floor((ibi - lo) / (hi - lo) * 16), 15) ELSE 0 END AS bin, count(*) / any_value(m)::DOUBLE AS p FROM s GROUP BY 1, 2, 3),
  e AS (SELECT rec, win, -sum(p * log2(p)) / 4 + 0.0 AS shannon FROM h GROUP BY rec, win),
  x AS (SELECT rec, win, row_number() OVER w AS i, ibi AS x0, lead(ibi, 1) OVER w AS x1, lead(ibi, 2) OVER w AS x2, 0.2 * stddev_pop(ibi) OVER (PARTITION BY rec, win) AS tol FROM cl WINDOW w AS (PARTITION BY rec, win ORDER BY t, beat)),
  g AS (SELECT a.rec, a.win, 2 * count(*) AS m2, 2 * count(*) FILTER (WHERE abs(a.x2 - b.x2) <= a.tol) AS m3 FROM x a JOIN x b ON a.rec = b.rec AND a.win = b.win AND a.i < b.i AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL AND abs(a.x0 - b.x0) <= a.tol AND abs(a.x1 - b.x1) <= a.tol GROUP BY a.rec, a.win),
  b AS (SELECT rec, win, bool_or(symbol = 'error') AS premature, rec % 3 = 0 AS af, count(*) AS n_beats, 60 / avg(ibi) AS hr_bpm FROM wb GROUP BY rec, win)
  SELECT b.rec, b.win, b.premature, b.af, b.n_beats, round(hr_bpm, 6) AS hr_bpm, coalesce(f.n, 0) AS n_ibis, CASE WHEN coalesce(f.n, 0) < 12 THEN 'few beats' END AS dropped,
    CASE WHEN f.n >= 12 THEN round(nrmssd, 6) END AS nrmssd, CASE WHEN f.n >= 12 THEN round(shannon, 6) END AS shannon_entropy, CASE WHEN f.n >= 12 THEN round(CASE WHEN m2 > 0 THEN -ln(greatest(m3, 1) / m2::DOUBLE) ELSE 0.0 END, 6) + 0.0 END AS sample_entropy,
    CASE WHEN f.n >= 12 THEN round(sd1_sd2, 6) END AS sd1_sd2, CASE WHEN f.n >= 12 THEN round(tpr, 6) END AS tpr
  FROM b LEFT JOIN f USING (rec, win) LEFT JOIN e USING (rec, win) LEFT JOIN g USING (rec, win)""")
def window_rows(spark, sf_dir):
    """Every window with its beats, rate, rhythm features or the reason why it has none."""
    return rounded(windows.window_rows(event_windows(spark, sf_dir)).drop("n_extra", "extra_removed"))


REMOVAL = f"""WITH {IN_WINDOWS}, m AS (SELECT *, lead(ibi) OVER w AS after, lag(ibi) OVER w AS outer1, lead(ibi, 2) OVER w AS outer2, count(*) OVER (PARTITION BY rec, win) AS beats,
  list_concat(coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 2 FOLLOWING AND 9 FOLLOWING), [])) AS around FROM wb WINDOW w AS (PARTITION BY rec, win ORDER BY t, beat)),
  med AS (SELECT *, CASE WHEN len(around) >= 3 THEN list_median(around) END AS mid FROM m), hits AS (SELECT *, coalesce(beats >= 5 AND ibi < (1 - 0.15) * mid AND after > 0.95 * mid, false) AS hit FROM med),
  st(setting, cap, tol) AS (VALUES ('none', 0.0::DOUBLE, NULL::DOUBLE), ('cap20', 0.2::DOUBLE, NULL), ('cap10_tol15', 0.1::DOUBLE, 0.15::DOUBLE)),
  c AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY rec, win, setting) AS hits FROM hits, st),
  few AS (SELECT *, hits > 0 AND hits <= cap * beats AS few, hit AND hits > 0 AND hits <= cap * beats AND (tol IS NULL OR (coalesce(abs(outer1 / mid - 1) <= tol, true) AND coalesce(abs(outer2 / mid - 1) <= tol, true))) AS gone FROM c),
  g AS (SELECT *, gone OR coalesce(lag(gone) OVER (PARTITION BY rec, win, setting ORDER BY t, beat), false) AS beside, count(*) FILTER (WHERE gone) OVER (PARTITION BY rec, win, setting) AS n_gone FROM few),
  kept AS (SELECT *, lag(ibi) OVER (PARTITION BY rec, win, setting ORDER BY t, beat) AS prev FROM g WHERE ibi BETWEEN 0.3 AND 2.0 AND NOT beside),
  n AS (SELECT rec, win, setting, count(*) AS n, sqrt(avg(pow(ibi - prev, 2))) / avg(ibi) AS nrmssd FROM kept GROUP BY 1, 2, 3),
  w AS (SELECT rec, win, setting, bool_or(symbol = 'error') AS premature, rec % 3 = 0 AS af, any_value(CASE WHEN few AND tol IS NOT NULL THEN n_gone ELSE hits END) AS n_extra, any_value(n_gone) > 0 AS removed FROM g GROUP BY 1, 2, 3),
  r AS (SELECT w.*, CASE WHEN coalesce(n.n, 0) < 12 THEN b.n ELSE n.n END AS n_ibis, CASE WHEN coalesce(n.n, 0) < 12 THEN b.nrmssd ELSE n.nrmssd END AS nrmssd
    FROM w JOIN n b ON b.rec = w.rec AND b.win = w.win AND b.setting = 'none' AND b.n >= 12 LEFT JOIN n ON n.rec = w.rec AND n.win = w.win AND n.setting = w.setting)"""


@query("removal_by_setting", f"{REMOVAL} SELECT rec, win, setting, premature, af, n_extra, removed, n_ibis, round(nrmssd, 6) AS nrmssd FROM r")
def removal_by_setting(spark, sf_dir):
    """Each window under every removal setting."""
    r = windows.removal_rows(event_windows(spark, sf_dir), SETTINGS)
    return rounded(r.select("rec", "win", "setting", "premature", "af", "n_extra", "removed", "n_ibis", "nrmssd"))


def _calls(spark, sf_dir):
    """Windows with a score under each setting; the irregularity rule stands for a classifier (1 or 0)."""
    r = windows.removal_rows(event_windows(spark, sf_dir), SETTINGS).withColumn("p", (F.round("nrmssd", 6) > IRREGULAR * 5).cast("double"))
    w = r.groupBy("rec", "win", "af", "premature").pivot("setting", ["none", *SETTINGS]).agg(F.max("p"))
    return reports.removal_table(w, ["none", *SETTINGS], reports.window_group(F.col("af"), F.col("premature")))


TABLE = f"""{REMOVAL}, p AS (SELECT rec, win, af, premature, setting, CASE WHEN round(nrmssd, 6) > 0.5 THEN 1.0 ELSE 0.0 END AS p FROM r),
  v AS (SELECT CASE WHEN af THEN 'AF' WHEN premature THEN 'non-AF with extra beats' ELSE 'non-AF without' END AS kind, count(*) FILTER (WHERE setting = 'none') AS windows,
    avg(p) FILTER (WHERE setting = 'none') AS none, avg(p) FILTER (WHERE setting = 'cap20') AS cap20, avg(p) FILTER (WHERE setting = 'cap10_tol15') AS cap10_tol15 FROM p GROUP BY 1)"""


@query("removal_table", f"{TABLE} SELECT kind, windows, round(none, 6) AS none, round(cap20, 6) AS cap20, round(cap10_tol15, 6) AS cap10_tol15 FROM v")
def removal_table(spark, sf_dir):
    return rounded(_calls(spark, sf_dir))


@query("choose_removal", f"""{TABLE}, picks AS (SELECT unnest(['cap20', 'cap10_tol15']) AS s, unnest([a.cap20, a.cap10_tol15]) AS af, unnest([e.cap20, e.cap10_tol15]) AS f, a.none AS base FROM v a, v e WHERE a.kind = 'AF' AND e.kind = 'non-AF with extra beats')
  SELECT coalesce((SELECT s FROM picks WHERE af >= base - 0.05 ORDER BY f, -af, s LIMIT 1), 'none') AS choice""")
def choose_removal(spark, sf_dir):
    return reports.choose_removal(_calls(spark, sf_dir), list(SETTINGS), "none", 0.05)


@query("loso_logreg")
def loso_logreg(spark, sf_dir):
    """Leave-one-subject-out probabilities of the window table; tests hold the method on separable data."""
    rows = windows.window_rows(event_windows(spark, sf_dir)).where("dropped IS NULL").withColumn("subject", F.col("rec") % 6)
    return rounded(models.leave_one_out(rows, list(windows.FEATURES), "af", "subject").select("rec", "win", "subject", "af", "p"), 4)


@query("screening_saved_model")
def screening_saved_model(spark, sf_dir):
    """A classifier trained on the windows of even records, saved with its gate, loaded, and applied to all windows: the
    decision of each record. Tests hold the decisions before and after loading against each other."""
    rows = windows.window_rows(event_windows(spark, sf_dir)).withColumn("quality", F.least(F.col("n_ibis") / F.col("n_beats"), F.lit(1.0)))
    bundle = models.train(rows.where("rec % 2 = 0 AND dropped IS NULL"), list(windows.FEATURES), "af", {"window_s": WIDTH, "least_quality": 0.6, "trained_on": "even records"})
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    models.save(bundle, path)
    return rounded(models.decide(models.screen(rows, models.load(spark, path)), "rec"), 4)
