"""Rhythm classifiers with pyspark.ml: training, leave-one-subject-out scores, gating sweeps, screening."""

from __future__ import annotations

import functools
import json
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.operators.metrics import auc
from pulsespark.streaming.monitor import shared_dir


def make_model(kind: str, features: list[str], label: str, rows: int) -> Pipeline:
    """logreg (scaled, ridge of strength 1 / rows) or forest (200 trees of 5 rows a leaf and more); classes weighed alike."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw")]
    if kind == "logreg":
        stages += [StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", regParam=1.0 / max(rows, 1), standardization=False, maxIter=100)]
    else:
        stages += [RandomForestClassifier(featuresCol="_raw", labelCol=label, weightCol="_weight", numTrees=200, minInstancesPerNode=5, seed=0)]
    return Pipeline(stages=stages)


def balanced(rows: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """rows with `_weight`, which makes both classes count alike, and the classes' sizes."""
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(0.0)
    for k, n in sizes.items():
        weight = F.when(F.col(label) == k, total / (len(sizes) * n)).otherwise(weight)
    return rows.withColumn("_weight", weight), sizes


def fit(rows: DataFrame, features: list[str], label: str, kind: str = "logreg") -> PipelineModel | None:
    """A model of rows whose label and features are known; None if only one class is left."""
    known = rows.dropna(subset=[label, *features]).withColumn(label, F.col(label).cast("double"))
    weighed, sizes = balanced(known, label)
    return make_model(kind, features, label, sum(sizes.values())).fit(weighed) if len(sizes) > 1 else None


def predict(model: PipelineModel | None, rows: DataFrame, out: str = "p") -> DataFrame:
    if model is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    return model.transform(rows.withColumn("_weight", F.lit(1.0))).withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def leave_one_out(rows: DataFrame, features: list[str], label: str, subject: str, kind: str = "logreg") -> DataFrame:
    """rows with `p` from a model that has not seen the row's subject. One fit a subject, on all others' rows; subjects
    are few by nature (a few dozen), and each fit is distributed."""
    path = f"{shared_dir(rows.sparkSession)}/subjects-{uuid.uuid4().hex}"
    rows.write.partitionBy(subject).parquet(path)  # read once a fit, which prunes the subject by its folder
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
    subjects = sorted(r[0] for r in rows.select(subject).distinct().collect() if r[0] is not None)
    out = None
    for s in subjects:
        scored = predict(fit(rows.where(F.col(subject) != F.lit(s)), features, label, kind), rows.where(F.col(subject) == F.lit(s)))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.withColumn("p", F.lit(None).cast("double"))


@dataclass(frozen=True)
class Bundle:
    """A classifier and what is needed to apply it: its features, gate and windows."""

    model: PipelineModel
    info: dict


def train(rows: DataFrame, features: list[str], label: str, info: dict, kind: str = "logreg") -> Bundle | None:
    """A bundle of a model of rows; info (window_s, least_quality, trained_on, ...) is kept with it."""
    model = fit(rows, features, label, kind)
    return None if model is None else Bundle(model, {**info, "features": features, "label": label, "kind": kind})


def save(bundle: Bundle, path: str) -> None:
    """The fitted pipeline, and what belongs to it as one row of JSON, in a folder that Spark can write."""
    spark = SparkSession.active()
    bundle.model.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(bundle.info),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load(spark: SparkSession, path: str) -> Bundle:
    return Bundle(PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/info").first()[0]))


def screen(windows: DataFrame, bundle: Bundle, quality: str = "quality", p: str = "p") -> DataFrame:
    """windows with `p` (null where a feature is unknown) and `reliable`: scored, and of at least the bundle's quality."""
    features = bundle.info["features"]
    known = functools.reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in features))
    scored = predict(bundle.model, windows.withColumn("_known", known).na.fill(0.0, features), "_p")
    out = scored.select(*[F.when(F.col("_known"), F.col(c)).alias(c) if c in features else F.col(c) for c in windows.columns], F.when(F.col("_known"), F.col("_p")).alias(p), F.col("_known"))
    return out.withColumn("reliable", F.col("_known") & F.coalesce(F.col(quality) >= bundle.info["least_quality"], F.lit(False))).drop("_known")


def gating_sweep(scored: DataFrame, gate: str, thresholds: list[float], label: str) -> DataFrame:
    """Per threshold over rows at or above it: AUC, sensitivity, specificity, and the share of each class kept."""
    t = scored.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    totals = scored.agg(F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) == 0).alias("tq"))
    kept = scored.join(F.broadcast(t), F.col(gate) >= F.col("threshold"))
    hit = (F.col("p") >= 0.5).cast("double")
    rates = kept.groupBy("threshold").agg(F.avg(F.when(F.col(label) == 1, hit)).alias("sensitivity"), (1 - F.avg(F.when(F.col(label) == 0, hit))).alias("specificity"))
    a = auc(kept, "p", F.col(label) == 1, "threshold")
    return rates.join(a, "threshold").join(F.broadcast(totals)).select("threshold", "auc", "sensitivity", "specificity", (F.col("p") / F.col("tp")).alias("coverage_1"), (F.col("q") / F.col("tq")).alias("coverage_0"))


def decide(windows: DataFrame, key: str, p: str = "p", reliable: str = "reliable") -> DataFrame:
    """Per recording: share of reliable windows and the decision from their mean probability."""
    g = windows.groupBy(key).agg(F.avg(F.when(F.col(reliable), F.col(p))).alias("mean_p"), F.avg(F.col(reliable).cast("double")).alias("coverage"))
    return g.withColumn("decision", F.when(F.col("mean_p").isNull(), "unreliable").when(F.round("mean_p", 9) >= 0.5, "possible AF").otherwise("regular rhythm"))
