"""The live status as a replayed stream of the events' beats, and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsespark.plans.catalog import BEATS, query, rounded
from pulsespark.sources.tables import UNIT, beats
from pulsespark.streaming import live
from pulsespark.streaming.monitor import shared_dir

HOW = live.Live(irregular=1.4, least_confidence=50.0, flag_after=10, idle=float("inf"), pauses=True)
SLICES, FILES = (24.0, 48.0), 4
#: Nothing is late: slices come in order, but a micro-batch may hold files of two, or a part of those of one.
LATENESS = "1000000000 seconds"


def arrivals(spark, sf_dir) -> str:
    """A folder of the beats in slices of time, each record's in one file a slice, as a recorder would leave them."""
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    b = beats(spark, sf_dir).where("rec IS NOT NULL").select("rec", (F.col("us") / UNIT).alias("t"), "v", F.lit(False).alias("reset"), "beat")
    for low, high in zip((None, *SLICES), (*SLICES, None), strict=True):
        part = b if low is None else b.where(F.col("t") > low)
        part = part if high is None else part.where(F.col("t") <= high)
        part.repartition(FILES, "rec").write.mode("append").parquet(folder)
    return folder


def batch_files(spark, folder: str) -> int:
    """Files of a micro-batch, so that there are no more of these than slices, however many files Spark wrote a slice."""
    return max(1, -(-len(spark.read.schema(live.ROWS).parquet(folder).inputFiles()) // (len(SLICES) + 1)))


def of_no_record(spark, sf_dir):
    """Statuses of the beats without a record, which have seconds, but are no record's beats in any of them."""
    t = F.col("us") / UNIT
    ends = beats(spark, sf_dir).where("rec IS NULL").agg((F.floor(F.min(t)) + 1).alias("low"), (F.ceil(F.max(t)) - 1).alias("high"))
    blank = {"seconds": "0D", "beats": "0L", "rhythm": "'collecting data'", "confident_s": "0L"}
    seconds = ends.where("low <= high").select(F.explode(F.sequence("low", "high")).alias("second"))
    return seconds.select(*[F.col("second") if c == "second" else F.expr(blank.get(c, "NULL")).cast(kind).alias(c) for c, kind in (x.split() for x in live.OUT.split(", "))])


def nearest(c: str, digits: int) -> Column:
    """A double rounded as its value times a power of ten is: `F.round` rounds the shortest decimal that reads as the double, so
    means of sixteen values of two decimals, which end in a five, would go up where the double lies below."""
    return (F.round(F.col(c) * 10.0**digits) / 10.0**digits).alias(c)


@query("live_status", f"""WITH {BEATS}, b AS (SELECT rec, beat, us / 3.6e10 AS t, v FROM beats), e AS (SELECT rec, unnest(range(floor(min(t))::BIGINT + 1, ceil(max(t))::BIGINT)) AS s FROM b GROUP BY rec),
  j AS (SELECT e.rec, s, t, beat, v, t - lag(t) OVER (PARTITION BY e.rec, s ORDER BY t, beat) AS ibi FROM e JOIN b ON b.rec = e.rec AND t > s - 32 AND t <= s),
  m AS (SELECT *, ibi - lag(ibi) OVER w AS d, lead(ibi) OVER w AS after, lag(t) OVER w AS before, count(*) OVER (PARTITION BY rec, s) AS beats,
    list_concat(coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), coalesce(list(ibi) FILTER (WHERE ibi IS NOT NULL) OVER (w ROWS BETWEEN 2 FOLLOWING AND 9 FOLLOWING), [])) AS around FROM j WINDOW w AS (PARTITION BY rec, s ORDER BY t, beat)),
  x AS (SELECT *, beats >= 5 AND len(around) >= 3 AND ibi < (1 - 0.15) * list_median(around) AND after > 0.95 * list_median(around) AS hit FROM m),
  g AS (SELECT rec, s, count(*) AS n, max(t) - min(t) AS seconds, avg(v) FILTER (WHERE t > s - 8) AS conf, sqrt(avg(d * d)) AS r, avg(ibi) AS mean, avg(ibi) FILTER (WHERE before > s - 8) AS last, count(*) FILTER (WHERE before > s - 8) AS n_last, count(*) FILTER (WHERE hit) AS extra FROM x GROUP BY 1, 2),
  a AS (SELECT e.rec, e.s, coalesce(n, 0) AS n, coalesce(seconds, 0.0) AS seconds, conf, r, extra, n >= 6 AND seconds >= 10 AS ready, r / mean > 1.4 AS irregular, r / mean > 1.4 AND n_last > 1 AS by_beats, CASE WHEN r / mean > 1.4 AND n_last > 1 THEN 60 / last ELSE 60 * (n - 1) / seconds END AS rate FROM e LEFT JOIN g USING (rec, s)),
  c AS (SELECT *, coalesce(ready, false) AS ok, coalesce(ready AND conf >= 50, false) AS sure FROM a),
  l AS (SELECT *, count(*) FILTER (WHERE sure) OVER w AS confident_s, list(rate) FILTER (WHERE sure) OVER w AS rates FROM c WINDOW w AS (PARTITION BY rec ORDER BY s)),
  f AS (SELECT *, CASE WHEN confident_s >= 10 THEN list_median(rates[-10:]) END AS mid FROM l)
  SELECT rec, s AS second, round(seconds, 6) AS seconds, n AS beats, CASE WHEN ok THEN round(rate, 5) END AS rate, CASE WHEN ok THEN CASE WHEN by_beats THEN 'beats' ELSE 'window' END END AS method, round(conf, 5) AS confidence, CASE WHEN ok THEN round(r * 1000, 4) END AS rmssd,
    CASE WHEN ok THEN extra END AS extra, CASE WHEN NOT ok THEN 'collecting data' WHEN NOT sure THEN 'signal unreliable' WHEN irregular THEN 'irregular rhythm' ELSE 'regular rhythm' END AS rhythm, confident_s, CASE WHEN mid < 50 THEN 'slow' WHEN mid > 100 THEN 'fast' WHEN mid IS NOT NULL THEN 'normal' END AS flag FROM f""")
def live_status(spark, sf_dir):
    """A status for every second (unit of time) of every record, by a stream of several micro-batches."""
    folder = arrivals(spark, sf_dir)
    got = live.replay(spark, folder, HOW, batch_files(spark, folder), LATENESS).unionByName(of_no_record(spark, sf_dir))
    return got.select("rec", "second", nearest("seconds", 6), "beats", nearest("rate", 5), "method", nearest("confidence", 5), nearest("rmssd", 4), "extra", "rhythm", "confident_s", "flag")
