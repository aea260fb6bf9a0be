"""Removal of repeated substrings by a column-wise built collection BWT.

The suffix structure of all documents cannot be one array on one machine, so documents are cut into pieces that can be
compared apart. Every window of LENGTH bytes has an anchor: among its ANCHOR-byte strings the one of least hash. A piece
is a maximal run of windows with one anchor, so equal windows always lie in pieces with equal anchors, wherever they
are, and the pieces of one anchor form a collection that needs no other. Equal pieces are one member of it. Each
collection gets its Burrows-Wheeler transform and common prefixes by inserting one symbol of every piece a round, from
the last to the first (`collection_bwt`); symbols are the 8-byte blocks counted from the anchor, so 25 rounds at most.
Rows whose common prefixes cover a window's blocks, and whose bytes beside them agree, are equal windows; all but the
earliest are removed.

The columns of a collection are rewritten sequentially in memory: a collection has about GROUP_BYTES, and files outside
the shared folder would be lost with an executor. What goes between tasks goes through Spark's shuffle files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import BASE, BASE_INV, BYTE, U64, documents, mix, partitions_for, powers, ragged, shared_dir, slices, stored, text_stats, utf8

LENGTH = 100
ANCHOR = 50
BLOCK = 8
#: Text hashed together in a task, text whose pieces meet in one bucket, buckets at least (a document's answers come
#: from as many buckets as its repeated pieces lie in), and piece bytes of a collection.
SLICE_BYTES = 2 << 20
BUCKET_BYTES, BUCKETS = 24 << 20, 32
GROUP_BYTES = 6 << 20
#: Anchors in a larger share of the sampled documents, and in so many of them at least, are chosen last. The sample
#: only sets this order, which any list leaves right; it has about SAMPLE_BYTES, and the list 60 / HOT_SHARE entries at most.
HOT_SHARE, HOT_LEAST, SAMPLE_BYTES = 0.004, 20, 32 << 20
NO_ID = -(1 << 63)
_POS = U64((1 << 28) - 1)  # texts up to 256 MB


class Pieces:
    """Pieces of some texts: text index, first byte, length (in bytes), place of the anchor, anchor and piece hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hot: np.ndarray):
        n, w = len(data), LENGTH - ANCHOR + 1
        empty = np.zeros(0, np.int64)
        self.text, self.start, self.size, self.left, self.anchor, self.id = empty, empty, empty, empty, empty.view(U64), empty.view(U64)
        if n < LENGTH:
            return
        prefix = np.zeros(n + 1, U64)
        np.cumsum(BYTE[data] * powers(BASE, n), out=prefix[1:])
        scale = powers(BASE_INV, n + 1)
        gram = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * scale[: n - ANCHOR + 1])
        order = gram >> U64(29)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
            order[hot[at] == gram] |= U64(1 << 35)
        order = (order << U64(28)) | np.arange(len(order), dtype=U64)
        k, least = 1, order
        while 2 * k <= w:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        least = np.minimum(least[: n - LENGTH + 1], least[w - k : w - k + n - LENGTH + 1])
        size = np.diff(offsets)
        windows = np.maximum(size - LENGTH + 1, 0)
        start = ragged(offsets[:-1], windows)
        if not len(start):
            return
        text = np.repeat(np.arange(len(size)), windows)
        anchor = (least[start] & _POS).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(heads[1:], len(start)) - 1
        begin, end, anchor = start[heads], start[last] + LENGTH, anchor[heads]
        self.text = text[heads]
        self.at = begin
        self.start, self.size, self.left = begin - offsets[:-1][self.text], end - begin, anchor - begin
        self.anchor = gram[anchor]
        self.id = mix(mix((prefix[end] - prefix[begin]) * scale[begin] + self.size.astype(U64)) ^ self.anchor, 3) >> U64(16)


def _pack(values: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return wide.view("<u8").reshape(-1)


def collection_bwt(sequences: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, suffix length, common prefix with the row before, at most `most`) of the sorted suffixes of all sequences.

    sequences: symbols (1 or more) one after another; lengths: of each. Round j inserts the suffix of length j of every
    sequence that has one: its row follows from the row of its own suffix one shorter by counting equal symbols before it
    in the transform, and the common prefixes of it and of the row after it from range minima of those so far.
    """
    n = len(lengths)
    ends = np.cumsum(lengths)
    bwt = np.where(lengths > 0, sequences[np.maximum(ends - 1, 0)], 0).astype(np.int32) if len(sequences) else np.zeros(n, np.int32)
    owner, length, common = np.arange(n, dtype=np.int32), np.zeros(n, np.int16), np.zeros(n, np.uint8)
    rows = np.flatnonzero(bwt)  # rows inserted last, whose preceding symbol has no row yet
    j = 0
    while len(rows):
        j += 1
        total = len(bwt)
        order = np.argsort(bwt, kind="stable")
        inverse = np.empty(total, np.int64)
        inverse[order] = np.arange(total)
        place = inverse[rows]
        new = n + place - int((bwt == 0).sum())
        minima = [common]  # minima[k][i] = min of common[i : i + 2 ** k]
        while 2 << (len(minima) - 1) <= total:
            k = 1 << (len(minima) - 1)
            minima.append(np.minimum(minima[-1][:-k], minima[-1][k:]))

        def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """min of common[lo : hi], for hi > lo."""
            level = np.frexp((hi - lo).astype(float))[1] - 1
            out = np.empty(len(lo), np.uint8)
            for k in np.unique(level):
                own = level == k
                out[own] = np.minimum(minima[k][lo[own]], minima[k][hi[own] - (1 << int(k))])
            return out

        symbol = bwt[rows]
        before = order[np.maximum(place - 1, 0)]
        after = order[np.minimum(place + 1, total - 1)]
        has_before = (place > 0) & (bwt[before] == symbol)
        has_after = (place + 1 < total) & (bwt[after] == symbol)
        up, down = np.zeros(len(rows), np.uint8), np.zeros(len(rows), np.uint8)
        up[has_before] = np.minimum(least(before[has_before] + 1, rows[has_before] + 1) + 1, most)
        down[has_after] = np.minimum(least(rows[has_after] + 1, after[has_after] + 1) + 1, most)

        who = owner[rows]
        preceding = np.where(lengths[who] > j, sequences[np.maximum(ends[who] - 1 - j, 0)], 0).astype(np.int32)
        old = np.ones(total + len(rows), bool)
        old[new] = False

        def merged(column: np.ndarray, inserted, old=old, new=new) -> np.ndarray:
            out = np.empty(len(old), column.dtype)
            out[old] = column
            out[new] = inserted
            return out

        bwt, owner, length, common = merged(bwt, preceding), merged(owner, who), merged(length, j), merged(common, up)
        common[new[has_after] + 1] = down[has_after]
        rows = np.sort(new[preceding > 0])
    return owner, length, common


def later_windows(texts: list[bytes], left: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of every window of LENGTH bytes that also lies in an earlier place of another of these pieces.

    left: place of the anchor in each piece; doc, start: where the piece is; windows are counted from the piece's start.
    """
    size = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(texts) + b"\0" * 16, np.uint8)
    lead = left % BLOCK
    blocks = (size - lead) // BLOCK
    at = ragged(np.zeros(len(texts), np.int64), blocks) * BLOCK + np.repeat(off[:-1] + lead, blocks)
    value = np.zeros(len(at), U64)
    for k in range(BLOCK):
        value = (value << U64(8)) | data[at + k]
    _, symbols = np.unique(value, return_inverse=True)
    most = LENGTH // BLOCK
    owner, length, common = collection_bwt(symbols.astype(np.int64) + 1, blocks, most)
    # class of each (piece, block) by common prefixes of at least k blocks
    first = np.concatenate([[0], np.cumsum(blocks + 1)])
    slot = first[owner] + blocks[owner] - length
    group = {}
    for k in (most - 1, most):
        group[k] = np.empty(len(owner), np.int64)
        group[k][slot] = np.cumsum(common < k)
    windows = size - LENGTH + 1
    piece = np.repeat(np.arange(len(texts)), windows)
    s = ragged(np.zeros(len(texts), np.int64), windows)
    b = -(-(s - lead[piece]) // BLOCK)
    d = lead[piece] + BLOCK * b - s
    k = (LENGTH - d) // BLOCK
    key = np.where(k == most, group[most][first[piece] + b], group[most - 1][first[piece] + b]).astype(U64)
    key = mix(key * U64(16) + d.astype(U64), 1)
    place = off[piece] + s
    beside = LENGTH - BLOCK * k
    for x in range(LENGTH - BLOCK * (most - 1)):
        more = beside > x
        byte = data[np.where(x < d, place + x, place + BLOCK * k + x)[more]]
        key[more] = mix(key[more] ^ (byte.astype(U64) + U64(256 * (x + 1))), 2)
    order = np.lexsort((start[piece] + s, doc[piece], key))
    repeat = np.zeros(len(order), bool)
    repeat[order[1:]] = key[order[1:]] == key[order[:-1]]
    return piece[repeat], s[repeat]


def hot_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of anchors in many documents, from a sample by a hash of the id."""
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    some = docs.where(F.pmod(F.xxhash64(F.lit(1), "d"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                p = Pieces(*utf8(part.column("t")), np.zeros(0, U64))
                keys = np.unique(np.stack([p.anchor, p.text.astype(U64)]), axis=1)[0]
                keys, n = np.unique(keys, return_counts=True)
                # an anchor is counted where a part has it twice, and a part without stays small
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["anchor", "n"])

    n = some.count()
    got = some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    got = got.where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * n)).collect()
    return np.sort(np.array([r["anchor"] for r in got], np.int64).view(U64))


def _asks(docs: DataFrame, hot, buckets: int) -> DataFrame:
    """A row for each slice of texts and bucket of anchors: packed anchors and piece ids, and the documents they are of.

    Of equal pieces in a slice only the earliest asks; the others are known to be later, and go with the row of the
    document's own bucket (`later_docs`, `later_counts`, `later`), so a piece in all documents asks once a slice.
    """
    schema = "bucket int, anchors binary, ids binary, docs array<bigint>, counts array<int>, later_docs array<bigint>, later_counts array<int>, later binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[heads], np.diff(np.append(heads, len(keys)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                p = Pieces(*utf8(part.column("t")), hot.value)
                if not len(p.id):
                    continue
                doc = part.column("d").to_numpy()[p.text]
                order = np.lexsort((p.start, doc, p.id))
                same = np.concatenate([[False], p.id[order[1:]] == p.id[order[:-1]]])
                owner = np.maximum.accumulate(np.where(same, -1, np.arange(len(order))))
                ask, later = order[~same], order[same & (doc[order] != doc[order[owner]])]
                bucket = (p.anchor[ask] % U64(buckets)).astype(np.int64)
                ask = ask[o := np.lexsort((doc[ask], bucket))]
                bucket, counts = runs(bucket[o])
                own = doc[later] % buckets
                later = later[o := np.lexsort((doc[later], own))]
                known = dict(zip(*(x.tolist() for x in runs(own[o])), strict=True))
                cuts = np.concatenate([[0], np.cumsum(counts)])
                asks = {b: ask[i:j] for b, i, j in zip(bucket.tolist(), cuts[:-1], cuts[1:], strict=True)}
                out, at = [], 0
                for b in sorted(asks.keys() | known.keys()):
                    a = asks.get(b, ask[:0])
                    x = later[at : at + known.get(b, 0)]
                    at += len(x)
                    (da, ca), (dx, cx) = runs(doc[a]), runs(doc[x])
                    out.append((b, _pack(p.anchor[a] >> U64(24), 5), _pack(p.id[a], 6), da, ca.astype(np.int32), dx, cx.astype(np.int32), _pack(p.id[x], 6)))
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(run, schema)


def _answers(asks: DataFrame) -> DataFrame:
    """(d, later, send): ids of a document's pieces that an earlier document has too, and of those to send as the
    earliest of their kind where their anchor has other pieces as well."""

    def run(table: pa.Table) -> pa.Table:
        anchors, ids, docs, out_doc, out_id = [], [], [], [], []
        for a, i, d, c, ld, lc, li in zip(*(table.column(x) for x in ("anchors", "ids", "docs", "counts", "later_docs", "later_counts", "later")), strict=True):
            anchors.append(_unpack(a.as_py(), 5))
            ids.append(_unpack(i.as_py(), 6))
            docs.append(np.repeat(d.values.to_numpy(), c.values.to_numpy()))
            out_doc.append(np.repeat(ld.values.to_numpy(), lc.values.to_numpy()))
            out_id.append(_unpack(li.as_py(), 6))
        anchor, piece, doc = np.concatenate(anchors), np.concatenate(ids), np.concatenate(docs)
        order = np.lexsort((doc, piece, anchor))
        anchor, piece, doc = anchor[order], piece[order], doc[order]
        n = len(anchor)
        first = np.ones(n, bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        owner = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, int)
        late = ~first & (doc != doc[owner])
        members = np.flatnonzero(first)
        cuts = np.flatnonzero(np.concatenate([[True], anchor[members][1:] != anchor[members][:-1]])) if n else np.zeros(0, int)
        several = np.repeat(np.diff(np.append(cuts, len(members))) > 1, np.diff(np.append(cuts, len(members))))
        send = members[several]
        doc_l, id_l = np.concatenate([doc[late], *out_doc]), np.concatenate([piece[late], *out_id])
        rows: dict[int, list[bytes]] = {}
        for j, (d, x) in enumerate(((doc_l, id_l), (doc[send], piece[send]))):
            order = np.argsort(d, kind="stable")
            d, x = d[order], x[order]
            heads = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, int)
            for a, b in zip(heads, np.append(heads, len(d))[1:], strict=True):
                rows.setdefault(int(d[a]), [b"", b""])[j] = _pack(x[a:b], 6)
        return pa.table({"d": pa.array(list(rows), pa.int64()), "later": pa.array([v[0] for v in rows.values()], pa.binary()), "send": pa.array([v[1] for v in rows.values()], pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, "d long, later binary, send binary")


def _sent(docs: DataFrame, answers: DataFrame, hot, groups: int) -> DataFrame:
    """(g, d, id, start, left, piece): the pieces to send, with their text; g deals anchors into collections."""
    wanted = answers.where(F.octet_length("send") > 0).groupBy("d").agg(F.collect_list("send").alias("send"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                data, offsets = utf8(part.column("t"))
                p = Pieces(data, offsets, hot.value)
                if not len(p.id):
                    continue
                doc = part.column("d").to_numpy()
                ids = [_unpack(b"".join(x), 6) for x in part.column("send").to_pylist()]
                want = mix(np.concatenate(ids) ^ (np.repeat(np.arange(len(ids)), [len(x) for x in ids]).astype(U64) << U64(48)), 4)
                have = mix(p.id ^ (p.text.astype(U64) << U64(48)), 4)
                keys, first = np.unique(have, return_index=True)
                own = np.sort(first[np.isin(keys, want)])
                texts = [data[a : a + n].tobytes() for a, n in zip(p.at[own], p.size[own], strict=True)]
                g = (mix(p.anchor[own] >> U64(24), 5) % U64(groups)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(doc[p.text[own]]), pa.array(p.id[own].view(np.int64)), pa.array(p.start[own]), pa.array(p.left[own]), pa.array(texts, pa.binary())], names=["g", "d", "id", "start", "left", "piece"])

    return docs.join(wanted, "d").select("d", "t", "send").mapInArrow(run, "g int, d long, id long, start long, left long, piece binary")


def _repeats(sent: DataFrame) -> DataFrame:
    """(d, id, lo, hi): bytes lo to hi of a document's piece that lie in windows with an earlier place."""

    def run(table: pa.Table) -> pa.Table:
        doc, ids, start, left = (table.column(c).to_numpy() for c in ("d", "id", "start", "left"))
        piece, window = later_windows(table.column("piece").to_pylist(), left, doc, start)
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        heads = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1)])) if len(piece) else np.zeros(0, int)
        last = np.append(heads[1:], len(piece)) - 1 if len(piece) else heads
        return pa.table({"d": doc[piece[heads]], "id": ids[piece[heads]], "lo": window[heads], "hi": window[last] + LENGTH})

    return sent.groupBy("g").applyInArrow(run, "d long, id long, lo long, hi long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, spans): kept is what stays of the text's UTF-8 bytes, spans the maximal removed runs.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a document of smaller doc_id, or further
    ahead in its own. Strings are judged on the input. Null text is empty; a null doc_id comes before all others. Rows
    that repeat a doc_id are not held against each other, and share what others make of their pieces. Extra columns are
    ignored. Hashes of 88 bits and more decide which pieces are equal; the rest is compared byte by byte.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    _, size = text_stats(base, "t")
    hot = spark.sparkContext.broadcast(hot_anchors(base, size))
    buckets = partitions_for(size, BUCKET_BYTES, BUCKETS)
    answers = stored(_answers(_asks(base, hot, buckets)), "answers")
    wanted = answers.agg(F.coalesce(F.sum(F.octet_length("send")), F.lit(0)).alias("n")).first()["n"]
    groups = partitions_for(wanted // 6 * 125, GROUP_BYTES)
    repeats = stored(_repeats(_sent(base, answers, hot, groups)), "repeats")
    later = answers.where(F.octet_length("later") > 0).groupBy("d").agg(F.collect_list("later").alias("later"))
    ranges = repeats.groupBy("d").agg(F.collect_list("id").alias("ids"), F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    joined = base.join(later.join(ranges, "d", "full"), "d", "left").select("d", "t", "later", "ids", "lo", "hi")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                data, offsets = utf8(part.column("t"))
                p = Pieces(data, offsets, hot.value)
                tag = lambda ids, text: mix(ids ^ (text.astype(U64) << U64(48)), 4)
                change = np.zeros(len(data) + 1, np.int32)
                if len(p.id):
                    lists = [_unpack(b"".join(x or ()), 6) for x in part.column("later").to_pylist()]
                    gone = tag(np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                    have = tag(p.id, p.text)
                    keys, first = np.unique(have, return_index=True)
                    again = np.ones(len(have), bool)
                    again[first] = False
                    again |= np.isin(have, gone)
                    np.add.at(change, p.at[again], 1)
                    np.add.at(change, p.at[again] + p.size[again], -1)
                    got = [x or [] for x in part.column("ids").to_pylist()]
                    if any(got):
                        which = np.repeat(np.arange(len(got)), [len(x) for x in got])
                        ids, lo, hi = (np.array([y for x in part.column(c).to_pylist() for y in x or ()], np.int64) for c in ("ids", "lo", "hi"))
                        at = np.minimum(np.searchsorted(keys, tag(ids.view(U64), which)), len(keys) - 1)
                        ok = keys[at] == tag(ids.view(U64), which)
                        head = p.at[first[at[ok]]]
                        np.add.at(change, head + lo[ok], 1)
                        np.add.at(change, head + hi[ok], -1)
                cut = np.cumsum(change[:-1]) > 0
                kept, spans = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    gone = cut[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2) if gone.any() else np.zeros((0, 2), np.int64)
                    kept.append(data[a:b][~gone].tobytes() if len(edge) else data[a:b].tobytes())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(spans, kind)], names=["d", "kept", "n_bytes", "spans"])

    out = joined.mapInArrow(run, "d long, kept binary, n_bytes long, spans array<struct<start:bigint,end:bigint>>")
    return out.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "kept", "n_bytes", "spans")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less what 100 bytes of it repeat; see remove_repeats. Null texts count as empty (0 bytes, 0 spans, the
    hash of nothing), repeated rows repeat each other, rows of one id are told apart by their text, an empty table gives none."""
    got = remove_repeats(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
