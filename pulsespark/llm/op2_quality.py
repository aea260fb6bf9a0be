"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import BYTE_LOWER, documents, schema_with, slices, span_hashes, utf8, words
from pulsespark.llm.op3_language import remainder

#: Labelled documents that the ranking is fitted on at most (chosen by a hash of their id), and pairs of each.
SAMPLE = 20_000
PAIRS_EACH = 8
RIDGE = 1e-3
THRESHOLD = 0.7


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


CLASSES = [_class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b"!"), _class(b"*#$%&"), _class(b"|"), _class(b".,;:?'\""), _class(b"-_/\\<>{}[]()=+~^@`"), _class(bytes(range(128, 256))), _class(b"\n")]
N_FEATURES = len(CLASSES) + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text: shares of byte classes, word and line statistics. An empty text is all zero."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    at = offsets[:-1][full]
    for j, table in enumerate(CLASSES):
        out[full, j] = np.add.reduceat(table[data], at, dtype=np.int64) / size[full]
    starts, ends, first = words(data, offsets)
    count = np.diff(first)
    some = np.flatnonzero(count)
    j = len(CLASSES)
    out[full, j] = np.log1p(size[full])
    if len(some):
        lens, head = ends - starts, first[:-1][some]
        out[some, j + 1] = np.add.reduceat(lens, head) / count[some]
        out[some, j + 2] = np.log1p(count[some])
        lead, tail = data[starts], data[ends - 1]
        letter = CLASSES[0] | CLASSES[1] | CLASSES[8]
        junk = CLASSES[3] | CLASSES[4] | CLASSES[5] | CLASSES[7]
        out[some, j + 3] = np.add.reduceat(junk[tail].astype(np.int64), head) / count[some]
        out[some, j + 4] = np.add.reduceat(CLASSES[0][lead].astype(np.int64), head) / count[some]
        out[some, j + 5] = np.add.reduceat((letter[lead] & letter[tail]).astype(np.int64), head) / count[some]
        # share of word pairs seen before in the text: loops and lists of few words
        owner = np.repeat(np.arange(n), count).astype(np.uint64)
        h = span_hashes(data, starts, ends, BYTE_LOWER)
        for k, share in ((6, h), (7, h + np.roll(h, -1) * np.uint64(3))):
            keys = np.sort((share >> np.uint64(13)) | (owner << np.uint64(51)))
            kept = np.ones(len(keys), bool)
            kept[1:] = keys[1:] != keys[:-1]
            out[some, j + k] = np.bincount((keys[kept] >> np.uint64(51)).astype(np.int64), minlength=n)[some] / count[some]
        out[some, j + 8] = np.log1p(np.maximum.reduceat(lens, head))
    return out


@dataclass
class Ranking:
    """score(text) = sigmoid(slope * weight . (x - mean) / scale + shift): rises with the Bradley-Terry strength."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self._expand(x) @ self.weight) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) / len(y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH) -> Ranking | None:
    """Weights that make a document of label 1 beat one of label 0; None if either label is missing.

    Every document meets `pairs_each` of the other label, by fixed strides, so a rerun gives the same pairs.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    out = Ranking(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(2 * x.shape[1]), 1.0, 0.0)
    z = out._expand(x)
    n = max(len(good), len(bad))
    i = np.concatenate([good[np.arange(n) % len(good)] for _ in range(pairs_each)])
    j = np.concatenate([bad[(np.arange(n) * (2 * k + 1) + 7 * k) % len(bad)] for k in range(pairs_each)])
    sign = np.where(np.arange(len(i)) % 2, 1.0, -1.0)
    out.weight = _newton((z[i] - z[j]) * sign[:, None], (sign + 1) / 2, RIDGE)
    strength = z @ out.weight
    # the pairs fix only differences; place and slope of the scale come from the labels themselves
    slope, shift = _newton(np.column_stack([strength, np.ones(len(y))]), y.astype(float), 1e-4)
    out.slope, out.shift = float(max(slope, 1e-6)), float(shift)
    return out


def _features_frame(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    schema = schema_with(docs.select(*keep), x="array<double>")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                x = features(*utf8(part.column(text)))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), values], names=[*keep, "x"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ranking | None:
    """Fits the ranking on labelled documents: about `sample` of them at most, chosen by a hash of the key.

    Only their features (a few numbers each) reach the driver. Labels other than 0 and 1 and repeated labels of a key
    that disagree are left out.
    """
    y = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y1")).where("y = y1")
    known = y.count()
    y = y.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < min(1.0, sample / max(known, 1)) * (1 << 20)).select(key, "y")
    joined = docs.select(key, text).join(F.broadcast(y) if min(known, sample) <= 1 << 20 else y, key)
    rows = _features_frame(joined, [key, "y"], text).collect()
    rows.sort(key=lambda r: (str(r[key]), r["x"]))
    return fit_ranking(np.array([r["x"] for r in rows]).reshape(len(rows), -1), np.array([r["y"] for r in rows])) if rows else None


def rate(docs: DataFrame, ranking: Ranking | None, text: str = "text") -> DataFrame:
    """docs with `score`: 0 to 1, higher where label 1 is likelier; 0.5 for all where nothing could be learned.

    Null text counts as empty. A column `score` that docs already has is replaced.
    """
    docs = docs.drop("score")
    schema = schema_with(docs, score="double")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                s = ranking.score(features(*utf8(part.column(text)))) if ranking else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def keep_above_quantile(scored: DataFrame, quantile: float, score: str = "score") -> DataFrame:
    """The rows at or above that quantile of the score (a sketch with relative error 1e-4)."""
    cut = scored.agg(F.percentile_approx(score, quantile, 10_000).alias("cut")).first()["cut"]
    return scored if cut is None else scored.where(F.col(score) >= cut)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from 0 to 1 of every document; see learn and rate. Null and empty texts have features like any text and get a score,
    texts of any length are read whole, repeated rows get equal scores, documents without a label are scored and not learnt
    from, an empty table gives none. A null id is not held out."""
    docs = documents(spark, sf_dir)
    ranking = learn(docs.where(remainder(4) != 2), documents(spark, sf_dir, "labels").where(remainder(4) != 2))
    scored = rate(docs.select("doc_id", "text"), ranking)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
