"""Shared helpers: ragged UTF-8 columns in numpy, word shingles, checkpoints, sizes.

Everything here works on one Arrow batch (or a slice of one) at a time, so memory is bounded by
``CHUNK_BYTES`` of text plus one longest text.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
U64 = np.uint64
#: ASCII white space of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters and digits (all bytes of other alphabets count as such).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers."""
    x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(256, dtype=U64), 11)
BYTE_LOWER = BYTE[LOWER]
BASE = U64(0xD6E8FEB86659FD93)
BASE_INV = U64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, U64)
        x[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(x)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = CHUNK_BYTES):
    """Slices of a batch with at most max_bytes of text (or one row) and CHUNK_ROWS rows."""
    _, offsets = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + CHUNK_ROWS, n)
        yield batch.slice(at, end - at)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (n + 1 values).

    `inside` says which bytes make up a word.
    """
    solid = inside[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_LOWER) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by prefix sums of a polynomial."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(table[data] * powers(BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(BASE_INV, n + 1)[starts] + (ends - starts).astype(U64))


def shingle_hashes(word: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and the text of each. A text of fewer than k words has one: the whole sequence."""
    counts = np.diff(first)
    n = len(word)
    out, owner = [], []
    if n >= k:
        total = np.zeros(n - k + 1, U64)
        for j in range(k):
            total += mix(word[j : n - k + 1 + j], 21 + j)
        text = np.repeat(np.arange(len(counts)), counts)
        whole = text[: n - k + 1] == text[k - 1 :]
        out.append(mix(total[whole]))
        owner.append(text[: n - k + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        total = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = counts[short] > j
            total[has] += mix(word[first[short[has]] + j], 21 + j)
        out.append(mix(total + counts[short].astype(U64)))
        owner.append(short)
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run, one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return base + np.arange(total)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context_dir.get() if context_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="pulsespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return str(found).rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written once to the shared folder and read again: cuts lineage, survives lost executors.

    Prefer this to ``checkpoint()`` where a result is read several times: Parquet is smaller and prunes columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables of stored() that no returned frame reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most `rows` rows of whole texts in an Arrow batch of this session, unless it asks for fewer; the usual 10,000 take
    some 100 MB a task on either side of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions_for(total_bytes: int, each: int = 16 << 20, least: int = 8) -> int:
    """Number of partitions that gives each about `each` bytes."""
    return max(least, math.ceil(total_bytes / each))


def text_stats(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text), by one column scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_with(df: DataFrame, **fields: str):
    """The schema of df and more columns (name=type); df's own schema object stays as it is."""
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, *(f for name, kind in fields.items() for f in T.StructType.fromDDL(f"`{name}` {kind}").fields)])
