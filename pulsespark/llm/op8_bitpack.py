"""Token ids in fixed-width bits, with block offsets for random access.

File format of one block (little endian): magic ``PKT1``, width in bits (u4), ids in the block (u8), payload bytes
(u8), then ids packed back to back, least significant bit first. A block holds a run of whole documents; the table of
blocks (shard, block, first document, ids before it) is the offset index, and ``starts`` the offsets of documents in it.
Blocks are rows of a Parquet table: Spark's committer makes the write safe when executors are lost, and any store that
Spark can write to holds them.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, partitions_for, ragged, shared_dir, text_stats

MAGIC = b"PKT1"
HEADER = struct.Struct("<4sIQQ")
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 18
#: Rows of the block table (three numbers each) that are broadcast at most; beyond it the join shuffles.
BROADCAST_BLOCKS = 1 << 18
#: Pieces, and parts of them, that a worker remembers (about 200 bytes each).
CACHE_WORDS = 700_000


def width_for(vocabulary: int) -> int:
    """Least bits that hold 0 .. vocabulary - 1."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """One block. Works on groups of 8 ids = `width` bytes, so it needs no temporary of a byte per bit and id."""
    n = len(ids)
    padded = np.zeros((-(-n // 8), 8), np.uint64)
    padded.reshape(-1)[:n] = ids
    out = np.zeros((len(padded), width), np.uint8)
    for j in range(8):
        lo, shift = divmod(j * width, 8)
        value = padded[:, j] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, lo + k] |= ((value >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)
    payload = out.tobytes()[: -(-n * width // 8)]
    return HEADER.pack(MAGIC, width, n, len(payload)) + payload


def unpack(block: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids start .. start + count of a block, reading only their bytes."""
    magic, width, n, size = HEADER.unpack_from(block)
    if magic != MAGIC or len(block) != HEADER.size + size:
        raise ValueError("not a block of packed ids")
    count = n - start if count is None else count
    if start < 0 or count < 0 or start + count > n:
        raise IndexError("ids outside the block")
    if not count:
        return np.zeros(0, np.uint32)
    group, skip = divmod(start, 8)
    groups = -(-(skip + count) // 8)
    raw = np.zeros(groups * width, np.uint8)
    have = np.frombuffer(block, np.uint8, offset=HEADER.size + group * width)[: groups * width]
    raw[: len(have)] = have
    raw = raw.reshape(groups, width)
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(8):
        lo, shift = divmod(j * width, 8)
        value = np.zeros(groups, np.uint64)
        for k in range((shift + width + 7) // 8):
            value |= raw[:, lo + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[skip : skip + count]


#: A run of Latin letters and the ASCII punctuation after it: the tokenizer splits exactly there.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class WordEncoder:
    """Encodes texts piece by piece, where white space (a blank or a line feed) splits them.

    The tokenizer's normalizer and splitter never join characters across white space, so the ids of a text are those of
    its pieces in order. Pieces made of Latin letters and then punctuation are split once more, as the tokenizer does.
    Each distinct part is encoded once while it stays in a cache of bounded size, which a worker keeps between tasks.
    """

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size, self.cache = self.tokenizer.get_vocab_size(with_added_tokens=True), cache
        self.ends_word = np.zeros(self.size, bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Rows are pieces (two parts each, the second often the empty part 0); parts are runs of ids in `flat`."""
        self.parts: dict[str, int] = {"": 0}
        self.part_starts, self.part_counts = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.rows = np.zeros((1 << 16, 2), np.int32)

    def _add_parts(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at, n = len(self.parts), len(new)
        while at + n > len(self.part_starts):
            self.part_starts, self.part_counts = np.concatenate([self.part_starts] * 2), np.concatenate([self.part_counts] * 2)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.part_counts[at : at + n] = counts
        self.part_starts[at : at + n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.parts.update(zip(new, range(at, at + n), strict=True))

    def _encode_parts(self, new: list[str], letters: bool) -> None:
        if not new:
            return
        if letters:  # together: each word ends with the one id that ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(new):
                return self._add_parts(new, ids, np.diff(cuts, prepend=0))
        each = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self._add_parts(new, np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each], np.int32))

    def _learn(self, new: list[str]) -> None:
        lead, tail, odd = [], [], set()
        for w in new:
            if m := _WORD.fullmatch(w):
                lead.append(m[1].lower())
                tail.append(m[2])
            else:
                lead.append(w)
                tail.append("")
                odd.add(w)
        parts = self.parts
        unknown = set(lead).difference(parts)
        self._encode_parts(list(unknown - odd), True)
        self._encode_parts(list((unknown & odd) | set(tail).difference(parts)), False)
        at, n = len(self.index), len(new)
        while at + n > len(self.rows):
            self.rows = np.concatenate([self.rows] * 2)
        self.rows[at : at + n, 0] = np.fromiter(map(parts.__getitem__, lead), np.int32, n)
        self.rows[at : at + n, 1] = np.fromiter(map(parts.__getitem__, tail), np.int32, n)
        self.index.update(zip(new, range(at, at + n), strict=True))

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.parts) > self.cache:
            self._forget()
        elif len(self.index) > self.cache:
            self._forget_pieces()
        blank = [(t or "").replace("\n", " ") for t in texts]
        pieces = " ".join(blank).split(" ")
        at = np.fromiter(map(self.index.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(pieces[i] for i in missing)))
            at[missing] = [self.index[pieces[i]] for i in missing]
        part = self.rows[at].reshape(-1)
        cuts = np.concatenate([[0], np.cumsum([t.count(" ") + 1 for t in blank])])
        per = np.add.reduceat(self.part_counts[part], 2 * cuts[:-1], dtype=np.int64)
        part = part[part > 0]
        ids = self.flat[ragged(self.part_starts[part], self.part_counts[part])]
        if end is None:
            return ids, per
        return np.insert(ids, np.cumsum(per), end), per + 1


@functools.cache
def encoder_for(path: str) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path)


def bounded_encoder(path: str, cache: int) -> WordEncoder:
    """The worker's encoder, which from now on remembers so many pieces and parts."""
    encoder = encoder_for(path)
    encoder.cache = cache
    return encoder


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_ids(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID, block_ids: int = BLOCK_IDS, doc_id: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Writes the packed ids of all texts in ascending doc_id order and returns the table of blocks, read back.

    One row per block: shard, block, packed (the format above), doc_ids, counts (ids of each document, end id included).
    Null text is empty (one end id). Null doc_id comes first. Repeated doc_ids are kept, in order of their text. Extra
    columns are ignored. A text that alone exceeds a block makes one larger block. An empty table gives no blocks.
    cache_words bounds what a worker remembers of the words it has met; ids do not depend on it.
    The text is dealt out by ranges of doc_id, so no task depends on a source or a group of copies.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    _, size = text_stats(docs.select(text), text)
    plan = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    plan = plan.repartitionByRange(partitions_for(size), F.col("d").asc_nulls_first())
    plan = plan.withColumn("shard", F.spark_partition_id()).sortWithinPartitions(F.col("d").asc_nulls_first(), F.col("t").asc_nulls_first())

    def encode(batches):
        encoder = bounded_encoder(tokenizer, cache_words)
        width = width_for(encoder.size)
        out: list[tuple] = []
        shard_now, block, held, ids, counts = None, 0, [], [], []

        def flush():
            nonlocal held, ids, counts, block
            if held:
                out.append((shard_now, block, pack(np.concatenate(ids), width), held, counts))
                block, held, ids, counts = block + 1, [], [], []

        def emit():
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4], pa.list_(pa.int64()))], names=["shard", "block", "packed", "doc_ids", "counts"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                d, t, s = (part.column(c).to_pylist() for c in ("d", "t", "shard"))
                got, per = encoder.encode(t, end)
                starts = np.concatenate([[0], np.cumsum(per)])
                for i in range(len(d)):
                    if s[i] != shard_now or size >= block_ids:
                        flush()
                        size = 0
                        if s[i] != shard_now:
                            shard_now, block = s[i], 0
                    held.append(d[i])
                    counts.append(int(per[i]))
                    ids.append(got[starts[i] : starts[i + 1]])
                    size += int(per[i])
            if len(out) >= 8:
                yield emit()
        flush()
        if out:
            yield emit()

    blocks = plan.mapInArrow(encode, "shard int, block int, packed binary, doc_ids array<bigint>, counts array<bigint>")
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    blocks.write.option("compression", "none").parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the packed blocks alone.

    start is the number of ids of all documents before it. Sums run per shard (one row a shard), never over all rows.
    """
    totals = blocks.groupBy("shard", "block").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    per_shard = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    before = per_shard.alias("x").selectExpr("shard", "sum(n) over (order by shard) - n as shard_start")
    starts = totals.selectExpr("shard", "block", "sum(n) over (partition by shard order by block) - n as block_start").join(before, "shard").selectExpr("shard", "block", "shard_start + block_start as start")
    few = totals.count() <= BROADCAST_BLOCKS
    placed = blocks.join(F.broadcast(starts) if few else starts, ["shard", "block"])

    def read(batches):
        for batch in batches:
            doc, start, n, crc = [], [], [], []
            for i in range(batch.num_rows):
                counts = np.array(batch.column("counts")[i].as_py(), np.int64)
                ids = unpack(batch.column("packed")[i].as_py()).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                doc += batch.column("doc_ids")[i].as_py()
                start.append(batch.column("start")[i].as_py() + ends - counts)
                n.append(counts)
                crc += [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(np.concatenate(start)), pa.array(np.concatenate(n)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document's ids in the packed files; see write_ids and read_ids. A null text has the end id
    alone, null ids come first, rows that repeat an id stay in order of their text, an empty table gives none."""
    return read_ids(write_ids(documents(spark, sf_dir)))
