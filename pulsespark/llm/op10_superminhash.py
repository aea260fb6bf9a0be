"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import U64, documents, free_name, mix, shingle_hashes, slices, span_hashes, stored, utf8, words
from pulsespark.llm._components import components

SHINGLE = 5
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Bits of a shingle's hash; the rest of the 64 hold a text's place in its batch while it is sorted.
BITS = 52
#: Bytes of a shingle in the sets that links are confirmed on: two shingles of a pair coincide by chance once in 10^12.
SET_BYTES = 5
#: Bytes of text whose sets and signatures are built at a time.
PART_BYTES = 1 << 18
#: Rows of a bucket, and bytes of their sets, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Document ids that a semi join broadcasts at most; beyond it the join shuffles.
BROADCAST_IDS = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of the texts in them."""
    starts, ends, first = words(data, offsets)
    hashes, owner = shingle_hashes(span_hashes(data, starts, ends), first, k)
    keys = np.sort((hashes >> U64(64 - BITS)) | (owner.astype(U64) << U64(BITS)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    cuts = np.searchsorted(keys, np.arange(len(offsets), dtype=U64) << U64(BITS))
    return keys & U64((1 << BITS) - 1), cuts


def superminhash(elements: np.ndarray, cuts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets of hashes; an empty set has only EMPTY.

    Element x puts the value j + r_j(x) into slot p_j(x), j = 0, 1, ..., where p is a random permutation of the slots
    made step by step and r_j is uniform in [0, 1). A slot keeps its least value. All elements of a text advance one
    rank at a time, and a text stops once all its slots are below the next rank, as no later value can be lower: texts
    of many shingles stop after the first. A value is rank << 32 | r.
    """
    n = len(cuts) - 1
    sig = np.full(n * slots, EMPTY)
    owner = np.repeat(np.arange(n), np.diff(cuts))
    swaps: list[np.ndarray] = []
    perm = None
    active = np.arange(len(elements))
    for j in range(slots):
        if not len(active):
            break
        x = elements[active]
        k = (j + mix(x, 1000 + j) % U64(slots - j)).astype(np.int64)
        value = (U64(j) << U64(32)) | (mix(x, 5000 + j) >> U64(32))
        if j == 0:
            place = k
            swaps.append(k)
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(active), 1))
                rows = np.arange(len(active))
                k0 = swaps[0][active]
                perm[rows, 0], perm[rows, k0] = k0, 0
            rows = np.arange(len(active))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = place
        np.minimum.at(sig, owner[active] * slots + place, value)
        worst = sig.reshape(n, slots).max(axis=1)
        on = (worst >= (U64(j + 1) << U64(32)))[owner[active]]
        if perm is not None:
            perm = perm[on]
        active = active[on]
    return sig.reshape(n, slots)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys, sig): 128 bits that stand for the set, a key for each band, 32 bits a slot."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", PART_BYTES):
                elements, cuts = shingle_sets(*utf8(part.column("t")))
                n, size = part.num_rows, np.diff(cuts)
                sig = superminhash(elements, cuts, bands * rows)
                sums = np.zeros((2, n), U64)
                some = np.flatnonzero(size)
                if len(some):
                    for i in range(2):
                        sums[i, some] = np.add.reduceat(mix(elements, 77 + i), cuts[:-1][some])
                keys = np.empty((n, bands), U64)
                for b in range(bands):
                    h = np.full(n, U64(b + 1))
                    for r in range(rows):
                        h = mix(h ^ sig[:, b * rows + r], r)
                    keys[:, b] = h
                short = (mix(sig.reshape(-1)) >> U64(32)).astype("<u4").reshape(n, -1)
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))), pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "keys", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<bigint>, sig binary")


def packed_sets(docs: DataFrame) -> DataFrame:
    """(d, set): the whole shingle set of a text, sorted, SET_BYTES bytes each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", PART_BYTES):
                elements, cuts = shingle_sets(*utf8(part.column("t")))
                raw = (elements << U64(64 - BITS)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array([raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["d", "set"])

    return docs.mapInArrow(run, "d long, set binary")


def _values(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // SET_BYTES, 8), np.uint8)
    wide[:, 8 - SET_BYTES :] = np.frombuffer(packed, np.uint8).reshape(-1, SET_BYTES)
    return wide.view(">u8").reshape(-1)


def _similar(va: np.ndarray, vb: np.ndarray, percent: int) -> bool:
    small, large = (va, vb) if len(va) < len(vb) else (vb, va)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(va) + len(vb) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their whole sets."""
    joined = pairs.join(sets.select(F.col("d").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("d").alias("a"), F.col("set").alias("set_a")), "a")

    def run(batches):
        for batch in batches:
            last, va = None, None
            keep = []
            for a, sa, sb in zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"), strict=True):
                if a != last:
                    last, va = a, _values(sa.as_py())
                keep.append(_similar(va, _values(sb.as_py()), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def linked_within(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket, confirmed on whole sets.

    rows: key, band, n (rows of the key), total (shingles of the key), d, size, sig, set, c (component so far). A pair
    is looked at only in the first band whose slots all agree, so once over all buckets. A bucket is dealt out as pairs
    of blocks of about BLOCK rows or BLOCK_BYTES, so no task sees a whole large one. A task gives only links that join
    components still apart in it, so fewer than it has rows, whatever the number of similar pairs.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") * SET_BYTES / BLOCK_BYTES)).cast("int")
    rows = rows.withColumn("nb", blocks).withColumn("i", F.pmod(F.xxhash64("d"), F.col("nb")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", "band", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "d", "size", "c", "sig", "set")

    def run(table: pa.Table) -> pa.Table:
        d, size, c, i = (table.column(x).to_numpy() for x in ("d", "size", "c", "i"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(len(d), -1)
        packed = table.column("set")
        band = table.column("band")[0].as_py()
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        a, b = [], []
        for u in left:
            v = right[(c[right] != c[u]) & (size[right] * 100 >= percent * size[u]) & (size[u] * 100 >= percent * size[right])]
            if lo == hi:
                v = v[d[v] > d[u]]
            same = sig[v] == sig[u]
            agree = same.sum(axis=1)
            own = same.reshape(len(v), sig.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) == band
            v = v[own][np.argsort(-agree[own], kind="stable")]
            if not len(v):
                continue
            own_set = _values(packed[int(u)].as_py())
            for w in v.tolist():
                x, y = find(int(c[u])), find(int(c[w]))
                if x != y and _similar(own_set, _values(packed[w].as_py()), percent):
                    root[max(x, y)] = min(x, y)
                    a.append(min(d[u], d[w]))
                    b.append(max(d[u], d[w]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of 5-word shingles; component_id is
    the smallest doc_id that links lead to. Texts with fewer words have one shingle, the whole sequence; null texts and
    texts without words have none and stay alone. Rows that repeat a doc_id count as one document with links of all
    of them. A null doc_id stays alone (component_id null, kept true). Extra columns are ignored.

    Equal sets become one representative first, by a combinable minimum. Representatives that share a band's key are
    candidates. Each bucket is first held against its best-connected member, which costs one pair a row. What then lies
    in different components of one bucket is confirmed on whole sets, block by block, likeliest signatures first, so no
    link within a bucket is left out that would join two components.
    """
    base = stored(signatures(docs, doc_id, text), "signatures")
    alike = base.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = alike.select(F.col("rep").alias("doc_id"), "n_shingles", "set_a", "set_b")
    bands = base.join(reps, ["doc_id", "n_shingles", "set_a", "set_b"], "left_semi").select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("size"), F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stored(bands.join(shared, "key").select("key", "band", "n", "d", "size"), "buckets")
    ids = buckets.select("d").distinct()
    small = ids.count() <= BROADCAST_IDS
    some = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).join(F.broadcast(ids) if small else ids, "d", "left_semi")
    sets = stored(packed_sets(some), "sets")

    degree = buckets.groupBy("d").agg(F.sum("n").alias("degree"))
    pivots = buckets.join(F.broadcast(degree) if small else degree, "d").groupBy("key").agg(F.max(F.struct("degree", -F.col("d"))).alias("m")).select("key", (-F.col("m.col2")).alias("p"))
    pairs = buckets.join(pivots, "key").where("d <> p").select(F.col("p").alias("a"), F.col("d").alias("b")).distinct()
    links = stored(confirm(pairs, sets, percent), "links")
    found = stored(components(links), "components")
    rows = buckets.join(F.broadcast(found) if small else found, F.col("d") == F.col("node"), "left").select("key", "band", "n", "d", "size", F.coalesce("component", "d").alias("c"))
    open_keys = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.sum("size").alias("total")).where("x < y").select("key", "total")
    rows = rows.join(open_keys, "key").join(base.select(F.col("doc_id").alias("d"), "n_shingles", "sig"), "d").where("size = n_shingles").drop("n_shingles").join(sets, "d").where(F.octet_length("set") == SET_BYTES * F.col("size"))
    links = links.union(stored(linked_within(rows, percent), "links"))
    found = components(links)
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(alike, ["n_shingles", "set_a", "set_b"], "left")
    named = out.join(found, out["rep"] == found["node"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates, the one of smallest id; all columns as they were.

    Texts that are null or hold no word are in no group, so all their rows stay. Where ids are repeated or null, rows count
    by id and text instead of by id: rows that repeat both are one group, rows of one id with different texts are apart,
    and null ids come after all others. Which of the rows that repeat id and text stays is open, as they differ at most
    in other columns. An empty table stays empty.
    """
    own = F.col(doc_id).cast("long")
    odd = docs.groupBy(own.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d is null or n > 1").limit(1).count()
    if not odd:
        gone = near_duplicates(docs, percent, doc_id, text).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
        return docs.join(gone, doc_id, "left_anti")
    row = F.xxhash64(own, F.col(text))
    keyed = docs.select(own.alias("id"), F.col(text).alias("t"), row.alias("row"))
    groups = near_duplicates(keyed, percent, "row", "t").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.max("n_shingles").alias("n")).where("n > 0")
    ids = keyed.groupBy(F.col("row").alias("doc_id")).agg(F.min("id").alias("id"))
    order = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id")).alias("m"))
    name = free_name(docs, "_row")
    best = groups.join(ids, "doc_id").groupBy("c").agg(order.alias("m")).select(F.col("m.doc_id").alias(name))
    rows = docs.withColumn(name, row)
    chosen = rows.join(best, name, "left_semi").dropDuplicates([doc_id, text])
    alone = rows.where(~F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return chosen.unionByName(alone).select(*docs.columns)


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all documents; see near_duplicates for nulls, short texts, repeated rows and empty tables. Sets
    are compared on 40-bit hashes of their shingles."""
    return near_duplicates(documents(spark, sf_dir))
