"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, mix, schema_with, slices

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
ALPHA = 0.5
#: Labelled texts per language that the model is fitted on at most (chosen by a hash of their id).
PER_LANGUAGE = 8000
#: Most bytes of the broadcast matrix; beyond it fewer buckets are used.
MATRIX_BYTES = 64 << 20
#: Bytes of text whose n-grams are held at a time (some 100 bytes for each character).
PART_BYTES = 1 << 18
UNDETERMINED = "und"


@dataclass
class Model:
    """languages, log prior, and log probabilities (bucket by language; the last bucket stands for "no n-gram")."""

    languages: list[str]
    prior: np.ndarray
    table: np.ndarray


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts one after another, and the offsets of the texts."""
    low = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), offsets


def ngram_buckets(texts: list[str], buckets: int):
    """For each n: the bucket of the n-gram at every character (`buckets` where the text ends before), and the offsets."""
    chars, offsets = _characters(texts)
    total = np.zeros(len(chars), np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(chars))
    for n in range(1, max(SIZES) + 1):
        k = n - 1
        if len(chars) > k:
            total[: len(chars) - k] = total[: len(chars) - k] * np.uint64(0x100000001B3) + chars[k:] + np.uint64(1)
        if n in SIZES:
            h = (mix(total, n) >> np.uint64(40)).astype(np.int64) % buckets
            h[at + k >= ends] = buckets
            yield h, offsets


def train(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fits the model on rows with a text and a language. None if there are none.

    At most about `per_language` rows of each language are used, chosen by a hash of `key`; counts are summed by Spark
    (one vector a task and language), and only language x bucket counts reach the driver.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    while buckets > 1024 and 4 * buckets * len(sizes) > MATRIX_BYTES:
        buckets //= 2
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    sample = known.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("l")) * (1 << 20)).select("l", "t").repartition(16)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "t", PART_BYTES):
                langs, texts = np.array(part.column("l").to_pylist(), object), part.column("t").to_pylist()
                for one in set(langs.tolist()):
                    have = sums.setdefault(one, np.zeros(buckets + 1, np.int64))
                    for h, _ in ngram_buckets([t for x, t in zip(langs, texts, strict=True) if x == one], buckets):
                        have += np.bincount(h, minlength=buckets + 1)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["l", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("v"))
        return pa.table({"l": [table.column("l")[0].as_py()], "v": pa.array([total.tobytes()], pa.binary())})

    got = sample.mapInArrow(count, "l string, v binary").groupBy("l").applyInArrow(add, "l string, v binary").collect()
    got = sorted((r["l"], np.frombuffer(r["v"], np.int64)) for r in got)
    if not got:
        return None
    table = np.zeros((buckets + 1, len(got)), np.float32)
    for j, (_, counts) in enumerate(got):
        counts = counts[:buckets].astype(float) + ALPHA
        table[:buckets, j] = np.log(counts / counts.sum())
    prior = np.log(np.array([sizes[k] for k, _ in got], float) / sum(sizes[k] for k, _ in got))
    return Model([k for k, _ in got], prior, table)


def score_texts(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the best language, its posterior) of each text; ties go to the language that sorts first."""
    log = np.tile(model.prior, (len(texts), 1))
    for h, offsets in ngram_buckets(texts, len(model.table) - 1):
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            log[full] += np.add.reduceat(model.table[h], offsets[:-1][full], axis=0, dtype=np.float64)
    best = log.argmax(axis=1)
    return best, 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)


def detect(docs: DataFrame, model: Model | None, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_pred and score (0 to 1), or columns of the names given.

    `und` with score 0 for a null text, a text without a letter, and every text where nothing could be learned. Columns
    of those two names that docs already has are replaced; all others stay. The matrix is broadcast (MATRIX_BYTES at most).
    """
    docs = docs.drop(lang_out, score_out)
    schema = schema_with(docs, **{lang_out: "string", score_out: "double"})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                texts = [t or "" for t in part.column(text).to_pylist()]
                ok = np.array([model is not None and any(map(str.isalpha, t)) for t in texts], bool)
                langs, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                if ok.any():
                    best, p = score_texts(model, [t for t, k in zip(texts, ok, strict=True) if k])
                    langs[ok], scores[ok] = np.array(model.languages, object)[best], p
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*part.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, schema)


def remainder(n: int, key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; see train and detect. Null texts and texts without a letter are `und` with score 0, ties go to
    the language that sorts first, repeated rows get equal answers, texts of any length are read whole, an empty table
    gives none. A null id is not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(remainder(3) != 1))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")
