"""Benchmark decontamination: a BM25 inverted index of test items, searched by every passage with block-max WAND."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import ALNUM, documents, ragged, shingle_hashes, slices, span_hashes, stored, utf8, words

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and overlaps of question and answer that confirm it. A changed
#: word breaks SHINGLE shingles at most, so a question of 12 words or more bears one and one of 20 words two.
THRESHOLD = 0.6
OVERLAP, ANSWER = 0.6, 0.6
SHINGLE = 3
#: Words of a question below which its words are compared instead of its shingles.
SHORT = 12
#: Items of a block with its own maximum; bytes of item texts that one index holds (and is broadcast with) at most.
BLOCK_ITEMS = 32
INDEX_BYTES = 16 << 20
#: Bytes of text that decontaminate() searches at a time, fewer than usual, as its worker stays beside those of other stages.
PART_BYTES = 1 << 18
WINDOW = 64


@dataclass
class Index:
    """Impacts are BM25 parts divided by the item's own score, so a whole copy of an item scores 1.

    terms: sorted hashes. starts, item, impact: postings of each term by item. block_starts, block, block_max: the
    greatest impact of each term in each block of items that it has. essential: terms of which any passage over the
    threshold has at least one, as all others together give no item THRESHOLD.
    """

    ids: list[int | None]
    terms: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_starts: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray
    window: int
    question: list[tuple[bool, np.ndarray]]
    answer: list[np.ndarray]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the term of each hash, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(data, starts, ends)


def _shingles(word: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(word, np.array([0, len(word)]), SHINGLE)[0])


def _grams(word: np.ndarray) -> tuple[bool, np.ndarray]:
    """Shingles of a question, or its words if it has fewer than SHORT."""
    long = len(word) >= SHORT
    return long, _shingles(word) if long else np.unique(word)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence is the answer; of a single sentence, its last quarter of words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if re.search(r"\w", p)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = len(w) - max(1, len(w) // 4)
    return " ".join(w[:cut]), " ".join(w[cut:])


@dataclass
class Statistics:
    """Of all items with a word: their number, mean and greatest length, and in how many each term (sorted) occurs."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def build_index(items: list[tuple[int | None, str]], threshold: float = THRESHOLD, of_all: Statistics | None = None) -> Index:
    """The index of (id, text) items; those without a word are left out. of_all: statistics, if these are but a part."""
    items = [(i, h, t) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")) if t and len(h := _hashes(t))]
    sizes = np.array([len(h) for _, h, _ in items], float)
    owner = np.repeat(np.arange(len(items)), sizes.astype(int))
    pairs, tf = np.unique(np.array([np.concatenate([h for _, h, _ in items]) if items else [], owner], np.uint64), axis=1, return_counts=True)
    term, item = pairs[0], pairs[1].astype(np.int64)
    terms, inverse, df = np.unique(term, return_inverse=True, return_counts=True)
    n, mean, longest, df_all = len(items), sizes.mean() if len(items) else 0.0, int(sizes.max(initial=0)), df
    if of_all is not None:
        n, mean, longest, df_all = of_all.n, of_all.mean, of_all.longest, of_all.df[np.searchsorted(of_all.terms, terms)]
    idf = np.log1p((n - df_all + 0.5) / (df_all + 0.5))
    norm = K1 * (1 - B + B * sizes / max(mean, 1)) if len(items) else sizes
    impact = idf[inverse] * tf * (K1 + 1) / (tf + norm[item])
    impact /= np.bincount(item, impact, minlength=len(items))[item]
    starts = np.concatenate([[0], np.cumsum(df)])
    block_of = item // BLOCK_ITEMS
    heads = np.flatnonzero(np.concatenate([[True], (inverse[1:] != inverse[:-1]) | (block_of[1:] != block_of[:-1])])) if len(item) else np.zeros(0, int)
    block_max = np.maximum.reduceat(impact, heads) if len(heads) else impact
    block_starts = np.searchsorted(inverse[heads], np.arange(len(terms) + 1)) if len(heads) else np.zeros(1, int)
    # the largest set of common terms that gives no item the threshold; the rest is essential
    essential = np.zeros(len(terms), bool)
    got = np.zeros(len(items))
    for t in np.argsort(-df, kind="stable"):
        own = slice(starts[t], starts[t + 1])
        if (got[item[own]] + impact[own]).max() >= threshold - 1e-9:
            essential[t] = True
        else:
            got[item[own]] += impact[own]
    split = [split_item(t) for _, _, t in items]
    return Index([i for i, _, _ in items], terms, starts, item, impact, block_starts, block_of[heads], block_max, essential, max(WINDOW, longest), [_grams(_hashes(q)) for q, _ in split], [np.unique(_hashes(a)) for _, a in split])


def _sums(row: np.ndarray, value: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row and their sums of value; row = passage * columns + column."""
    keys, inverse = np.unique(row, return_inverse=True)
    return keys, np.bincount(inverse, value, minlength=len(keys))


def search(index: Index, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap) of all items that a passage of a text holds.

    Passages are windows of two window lengths of words, one length apart, so each run of words as long as the longest
    item lies in one. Passages without an essential term cannot reach the threshold and are skipped; of the others,
    blocks of items whose sum of maxima stays below it are skipped too; the rest is scored in full.
    """
    starts, ends, first = words(data, offsets, ALNUM)
    if not len(starts) or not len(index.ids):
        return []
    hashes = span_hashes(data, starts, ends)
    term = index.find(hashes)
    step = index.window
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - first[:-1][text]
    per_text = np.maximum(1, -(-counts // step))
    base = np.concatenate([[0], np.cumsum(per_text)])
    cell = base[text] + place // step  # a passage is a cell and the next one of its text
    hit = np.zeros(base[-1] + 1, bool)
    hit[cell[(term >= 0) & index.essential[term]]] = True
    last = np.zeros(base[-1] + 1, bool)
    last[base[1:] - 1] = True
    live = hit[:-1] | (np.append(hit[1:-1], False) & ~last[:-1])
    known = term >= 0
    own = np.flatnonzero(known & live[cell])
    prev = np.flatnonzero(known & (place >= step) & live[np.maximum(cell - 1, 0)])
    n_terms = len(index.terms)
    pairs = np.unique(np.concatenate([cell[own] * n_terms + term[own], (cell[prev] - 1) * n_terms + term[prev]]))
    passage, t = np.divmod(pairs, n_terms)
    # block-max: sums of the greatest impacts in each block of items
    n_blocks = -(-len(index.ids) // BLOCK_ITEMS)
    some = index.block_starts[t + 1] - index.block_starts[t]
    at = ragged(index.block_starts[t], some)
    keys, upper = _sums(np.repeat(passage, some) * n_blocks + index.block[at], index.block_max[at], n_blocks)
    keys = keys[upper >= threshold - 1e-9]
    if not len(keys):
        return []
    keep = np.isin(passage, keys // n_blocks)
    passage, t = passage[keep], t[keep]
    some = index.starts[t + 1] - index.starts[t]
    at = ragged(index.starts[t], some)
    where = np.repeat(passage, some)
    inside = np.isin(where * n_blocks + index.item[at] // BLOCK_ITEMS, keys)
    keys, score = _sums(where[inside] * len(index.ids) + index.item[at][inside], index.impact[at][inside], len(index.ids))
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    for key, value in zip(keys[score >= threshold].tolist(), score[score >= threshold].tolist(), strict=True):
        p, i = divmod(key, len(index.ids))
        x = int(np.searchsorted(base, p, side="right")) - 1
        lo = first[x] + (p - base[x]) * step
        word = hashes[lo : min(lo + 2 * step, first[x + 1])]
        long, grams = index.question[i]
        q = float(np.isin(grams, _shingles(word) if long else word).mean()) if len(grams) else 1.0
        a = float(np.isin(index.answer[i], word).mean()) if len(index.answer[i]) else 1.0
        if q >= OVERLAP and a >= ANSWER:
            out[x, i] = max(out.get((x, i), (0.0, 0.0, 0.0)), (value, q, a))
    return [(x, i, *v) for (x, i), v in sorted(out.items())]


def _statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """((number, mean, greatest length), (h, df, parts): each term, its items, and the parts it occurs in) of (i, t, p)."""

    def run(batches):
        for batch in batches:
            words_of = [_hashes(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array([len(h) for h in words_of], pa.int64()), pa.array([np.unique(h).view(np.int64) for h in words_of], pa.list_(pa.int64()))], names=["p", "n", "h"])

    each = stored(items.select("t", "p").mapInArrow(run, "p int, n long, h array<bigint>").where("n > 0"), "items")
    row = each.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    terms = each.select("p", F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.collect_set("p").alias("parts"))
    return (row["n"], row["words"] / row["n"] if row["n"] else 0.0, row["longest"] or 0), stored(terms, "terms")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents that hold a test item, one row per pair.

    A passage qualifies if it reaches THRESHOLD of the item's own BM25 score, OVERLAP of the question's 3-word shingles
    (its words, if it has fewer than SHORT) and ANSWER of the answer's words, so that items with a changed word are found. Texts are split at anything but letters and digits, in lower case. Null and
    empty texts and items hold nothing. Rows that repeat a doc_id each count. The items' size is measured first: an
    index holds INDEX_BYTES of them, and is broadcast; larger benchmarks take several indexes, each searched by all
    passages. Numbers and lengths of items and the items of each term are those of all items in every index, so scores do
    not depend on their number. Items with a null id are searched too (item_id null).
    """
    out = None
    for shared in _indexes(docs.sparkSession, benchmark, item_id, item_text):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch, "t"):
                    got = search(index, *utf8(pc.utf8_lower(part.column("t"))))
                    if got:
                        x, i, s, q, a = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("d").take(pa.array(x, pa.int64())), pa.array([index.ids[k] for k in i], pa.int64()), pa.array(s), pa.array(q), pa.array(a)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.union(found)
    return out


def _indexes(spark: SparkSession, benchmark: DataFrame, item_id: str, item_text: str):
    """A broadcast index of each part of the benchmark, one after another."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(size) // INDEX_BYTES))
    items = items.withColumn("p", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int"))
    if parts > 1:
        whole, terms = _statistics(items)
    for p in range(parts):
        of_all = None
        if parts > 1:
            own = terms.where(F.array_contains("parts", p)).select("h", "df").toArrow()
            h, df = own.column("h").to_numpy().view(np.uint64), own.column("df").to_numpy()
            of_all = Statistics(*whole, h[np.argsort(h)], df[np.argsort(h)])
        yield spark.sparkContext.broadcast(build_index([(r["i"], r["t"]) for r in items.where(F.col("p") == p).collect()], of_all=of_all))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a test item; all columns as they were.

    Each row is judged by its own text, whatever its id: null and repeated ids make no difference, repeated rows stay or go
    alike, null and empty texts stay. Rows are filtered where they are read, without a join or a shuffle.
    """
    for shared in _indexes(docs.sparkSession, benchmark, item_id, item_text):

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch, text, PART_BYTES):
                    clean = np.ones(part.num_rows, bool)
                    clean[[hit[0] for hit in search(index, *utf8(pc.utf8_lower(part.column(text))))]] = False
                    if clean.any():
                        yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark; see contaminated."""
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
