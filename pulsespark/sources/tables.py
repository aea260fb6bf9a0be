"""Readers: driver tables mapped to beats, signals and patches, and text formats of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of a unit of time of the events (10 hours), so that gaps are of the order of heartbeats in seconds.
UNIT = 3.6e10
EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as beats: rec, beat, us (microseconds since 2024), symbol, v."""
    e = table(spark, sf_dir, "events")
    us = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(F.col("user_id").alias("rec"), F.col("event_id").alias("beat"), us.alias("us"), F.col("event_type").alias("symbol"), F.col("value").alias("v"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as packed signals: rec, label, values."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), "label", F.col("embedding").cast("array<double>").alias("values"))


def read_waveform_csv(spark: SparkSession, path: str, schema: str = "t_ms double, hr double, spo2 double, ppg double") -> DataFrame:
    """Header-less CSV recordings: rec (file name), t in seconds from the first row, ppg."""
    rows = spark.read.csv(path, schema=schema).withColumn("rec", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1))
    start = rows.groupBy("rec").agg(F.min("t_ms").alias("t0"))
    return rows.join(F.broadcast(start), "rec").select("rec", ((F.col("t_ms") - F.col("t0")) / 1000).alias("t"), "ppg", "hr")


def read_waveform_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text recordings of three lines (waveform, rates, times): rec, i, ppg, t; t is null if it is not as long."""
    lines = spark.read.text(path, wholetext=True).withColumn("rec", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1))
    parts = lines.select("rec", F.split("value", "\n").alias("l"))
    numbers = lambda k: F.transform(F.filter(F.split(F.trim(F.coalesce(F.try_element_at("l", F.lit(k)), F.lit(""))), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    p = parts.select("rec", numbers(1).alias("ppg"), numbers(3).alias("t"))
    return p.select("rec", F.posexplode("ppg").alias("i", "ppg"), "t").select("rec", "i", "ppg", F.try_element_at("t", F.col("i") + 1).alias("t"))


def read_annotations(spark: SparkSession, path: str, fs: float = 360.0) -> DataFrame:
    """Annotation listings (time, sample, symbol, four numbers, aux): rec, beat, t, symbol, aux."""
    rows = spark.read.text(path).withColumn("rec", F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]*$", 1)).withColumn("p", F.split(F.trim("value"), r"\s+"))
    rows = rows.withColumn("sample", F.try_element_at("p", F.lit(2)).try_cast("long")).where("sample IS NOT NULL")
    return rows.select("rec", F.col("sample").alias("beat"), (F.col("sample") / fs).alias("t"), F.try_element_at("p", F.lit(3)).alias("symbol"), F.try_element_at("p", F.lit(7)).alias("aux"))


def write_report(report: DataFrame, path: str, form: str = "parquet") -> None:
    report.write.mode("overwrite").option("header", True).format(form).save(path)


def markdown(report: DataFrame, digits: int = 3) -> DataFrame:
    """Rows of a report as one column of Markdown table lines."""
    cell = lambda f: F.format_number(f, digits) if dict(report.dtypes)[f] in ("double", "float") else F.col(f).cast("string")
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(f), F.lit("")) for f in report.columns]), F.lit(" |")).alias("line"))
