"""A corpus pipeline of five stages: language, near-duplicates, benchmark leaks, mixture, packed token ids.

STAGES lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame, and works on all rows that its
predecessor kept. All but the last return the columns of documents, whatever other columns these have and whatever their
names. Every stage gives an empty table for an empty one. Null and empty texts are rejected by the first stage; in the
others, which may be called alone, they are in no group, hold no item, are in no mixture and have the end id alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm import op3_language, op5_mixing, op8_bitpack, op9_bm25, op10_superminhash
from pulsespark.llm._common import bounded_batches, documents, free_name, shared_dir


#: Words that a tokenizing worker remembers, fewer than usual, as it stays beside the workers of the other stages.
CACHE_WORDS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from labelled documents and rejects those without a determinable language: no text, no letter, or no
    language likelier than all others together. The others take the predicted language. Each row is judged by itself, so
    repeated rows stay or go alike; ties between languages go."""
    bounded_batches(spark)
    model = op3_language.train(documents(spark, sf_dir))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    known = op3_language.detect(docs, model, lang_out=lang, score_out=score).where((F.col(lang) != op3_language.UNDETERMINED) & (F.col(score) > 0.5))
    return known.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: 5-word shingles, similarity 0.8 or more. Of rows
    that repeat id and text one stays; null ids come after all others."""
    bounded_batches(spark)
    return op10_superminhash.drop_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by itself; null items are held by none."""
    bounded_batches(spark)
    return op9_bm25.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that the mix takes a document. A null source is a source."""
    return op5_mixing.apply_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids, read back: doc_id, start, n_tokens, ids_crc32; a row for each row, in ascending doc_id order."""
    bounded_batches(spark)
    return op8_bitpack.read_ids(op8_bitpack.write_ids(docs, cache_words=CACHE_WORDS))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("token_ids", token_ids)]

#: Naive Bayes, signatures, BM25 and a tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again by the next stage."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
