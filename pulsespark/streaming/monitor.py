"""Live monitoring: watermarked windows, and a per-record buffer of recent beats as keyed state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsespark.settings import IBI_RANGE, IRREGULAR

MICROS_A_DAY = 86_400_000_000


def daily(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """(rec, day, beats, total) of a stream (rec, ts, us, v): tumbling windows of a day, late rows dropped by watermark."""
    w = stream.withWatermark("ts", watermark).groupBy("rec", F.floor(F.col("us") / MICROS_A_DAY).alias("day"), F.window("ts", "1 day"))
    return w.agg(F.count(F.lit(1)).alias("beats"), F.sum("v").alias("total")).select("rec", "day", "beats", F.round("total", 4).alias("total"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A file source read as a stream to its end. Each micro-batch gives the windows that it changed, in a folder of its
    own (a repeated batch overwrites it); the last state of each window is the result. Windows that the watermark has
    passed leave the state, so it stays small."""
    source = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", name).parquet(folder)
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    rows = stream.select(F.col("user_id").alias("rec"), us.alias("us"), F.col("value").alias("v")).withColumn("ts", F.timestamp_micros("us"))
    shared = shared_dir(spark)
    out = f"{shared}/monitor-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = daily(rows).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = spark.read.parquet(out).groupBy("rec", "day").agg(F.max_by(F.struct("beats", "total"), "batch").alias("m"))
    return last.select("rec", "day", "m.beats", "m.total")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may have none, and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="pulsespark-")
    return str(found).rstrip("/")


def rhythm_state(stream: DataFrame, span: float = 30.0, least: int = 6) -> DataFrame:
    """(rec, t, n, rate, irregular) after each micro-batch of a stream (rec, ts, t): the beats of the last `span` seconds
    of event time are kept per record, in time order, and nothing older. Records never leave the state here; where they
    come and go, use `live.status_stream`, whose timers close idle ones."""

    def step(key, frames, state: GroupState):
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held += [float(x) for x in f["t"] if x == x]
        held = sorted(set(held))
        if not held:
            return
        held = [x for x in held if x > held[-1] - span]
        state.update((held,))
        ibi = [b - a for a, b in zip(held, held[1:], strict=False) if IBI_RANGE[0] <= b - a <= IBI_RANGE[1]]
        if len(held) < least or len(ibi) < 2:
            yield pd.DataFrame({"rec": [key[0]], "t": [held[-1]], "n": [len(held)], "rate": [None], "irregular": [None]})
            return
        mean = sum(ibi) / len(ibi)
        r = (sum((b - a) ** 2 for a, b in zip(ibi, ibi[1:], strict=False)) / (len(ibi) - 1)) ** 0.5 / mean
        yield pd.DataFrame({"rec": [key[0]], "t": [held[-1]], "n": [len(held)], "rate": [60 / mean], "irregular": [r > IRREGULAR]})

    return stream.groupBy("rec").applyInPandasWithState(step, "rec long, t double, n long, rate double, irregular boolean", "held array<double>", "update", GroupStateTimeout.NoTimeout)
