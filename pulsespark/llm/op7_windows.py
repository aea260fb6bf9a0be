"""Near-duplicate passages of documents by compact windows.

Tokens are 5-word shingles. For a hash function, a node (a, c, b) of the Cartesian tree over a text's token hashes (least
hash on top) is a compact window: all subsequences that begin in a..c and end in c..b have the token at c as their
min-hash. Nodes that span a passage (WINDOW tokens) count. The windows of ROWS functions are joined as intervals within a
text: where one passage lies in all of them they make a band, and texts with the same min-hashes in a band are candidates
there. Passages are then verified on whole token sets.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import BASE, BASE_INV, bounded_batches, U64, documents, mix, partitions_for, powers, ragged, shared_dir, shingle_hashes, slices, span_hashes, stored, text_stats, utf8, words

SHINGLE = 5
#: Words of a passage at least, and its tokens.
PASSAGE = 50
WINDOW = PASSAGE - SHINGLE + 1
SIMILARITY = 80
#: Bands and functions of a band: a passage of similarity 0.8 and 50 words is missed in all of them once in 150 times,
#: a longer one less often.
BANDS, ROWS = 7, 3
#: Text whose windows leave a task together, and of them text hashed (or held against another) at a time; text whose windows meet in one bucket, and buckets at least (a pair of documents
#: has a row for each bucket that its collisions lie in).
SLICE_BYTES, PART_BYTES = 2 << 20, 1 << 18
BUCKET_BYTES, BUCKETS = 24 << 20, 32
#: Rows that a join broadcasts at most (two numbers each); beyond it the join shuffles.
BROADCAST_ROWS = 1 << 20
#: Partners of a document that meet its text in one task, and places of a key that one task compares with as many others.
PARTNERS, BLOCK = 256, 2048
#: Keys of few places that one task call takes.
BIN_KEYS = 128
#: Places of whole keys whose tokens a task holds side by side (or one key's); a key's places that are compared in all pairs at
#: once, and pairs of places looked at together.
PLACES, FEW_PLACES, PAIR_ROWS = 1024, 32, 1024
#: Bytes of a token in the surroundings of a place.
TOKEN_BYTES = 5
#: A collision: its key and its place in the document of larger id.
HIT = np.dtype([("key", "<i8"), ("place", "<u4")])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts of SHINGLE words and more, in order, and the offsets of the texts in them."""
    starts, ends, first = words(data, offsets)
    hashes, owner = shingle_hashes(span_hashes(data, starts, ends), first, SHINGLE)
    n = int(np.maximum(np.diff(first) - SHINGLE + 1, 0).sum())
    return hashes[:n], np.searchsorted(owner[:n], np.arange(len(offsets)))


def _heads(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _starts(cuts: np.ndarray, window: int) -> np.ndarray:
    """All places at which `window` tokens of one text begin."""
    counts = np.maximum(np.diff(cuts) - window + 1, 0)
    return np.repeat(cuts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())


def function_hashes(token: np.ndarray, function: int) -> np.ndarray:
    """26 bits of a hash function of each token, above six that are nought."""
    seed = mix(np.array([2 * function, 2 * function + 1], U64))
    return (((token ^ seed[0]) * (seed[1] | U64(1))) >> U64(32)).astype(np.uint32) & ~np.uint32(63)


def compact_windows(token: np.ndarray, cuts: np.ndarray, function: int, window: int = WINDOW, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, c, high) of all nodes (a, c, b) of the texts' Cartesian trees with b - a + 1 >= window, by place: the passages of
    `window` tokens in the node's compact window begin in low = max(a, c - window + 1) .. high = min(c, b - window + 1).

    The least of every `window` neighbours runs through exactly these nodes from left to right, so the tree is read off
    it. Of equal hashes the one whose place has the least remainder by 64 is on top (window is 64 at most, so one is).
    start: _starts of the same texts, where it is known.
    """
    n = len(token)
    start = _starts(cuts, window) if start is None else start
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    least = function_hashes(token, function)
    least |= np.arange(n, dtype=np.uint32) & np.uint32(63)
    k = 1
    while 2 * k <= window:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: n - window + 1], least[window - k : n - k + 1])[start]
    runs = np.ones(len(start), bool)
    runs[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    low = start[runs]
    last = np.append(np.flatnonzero(runs)[1:] - 1, len(start) - 1)
    return low, low + ((least[runs].astype(np.int64) - low) & 63), start[last]


def bands(token: np.ndarray, cuts: np.ndarray, n_bands: int = BANDS, rows: int = ROWS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the first function's node, key) of all compact windows of `rows` functions that share a passage.

    The intervals low .. high of a function follow one another without gaps, so their join is a merge of where they begin.
    """
    text, place, keys = [], [], []
    start = _starts(cuts, window)
    for band in range(n_bands):
        nodes = []
        for r in range(rows):
            nodes.append(compact_windows(token, cuts, 40 + rows * band + r, window, start)[:2])
        lows = np.sort(np.concatenate([lo for lo, _ in nodes]))
        lows = lows[_heads(lows)]
        tops = [c[np.searchsorted(lo, lows, side="right") - 1] for lo, c in nodes]
        if not len(lows):
            continue
        key = np.full(len(lows), U64(band + 1))
        for r, c in enumerate(tops):
            key = mix(key ^ token[c], 90 + r)
        owner = np.searchsorted(cuts, lows, side="right") - 1
        text.append(owner)
        place.append(tops[0] - cuts[owner])
        keys.append(key)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(text), np.concatenate(place), np.concatenate(keys)


def _entries(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each slice of texts and bucket: windows (key, document, place)."""
    names = ["bucket", "keys", "places", "docs", "counts"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                found = []
                for piece in slices(part, "t", PART_BYTES):
                    text, place, key = bands(*tokens(*utf8(piece.column("t"))))
                    found.append((piece.column("d").to_numpy()[text], place, key))
                doc, place, key = (np.concatenate(v) for v in zip(*found, strict=True))
                if not len(key):
                    continue
                bucket = (key % U64(buckets)).astype(np.int64)
                order = np.lexsort((doc, bucket))
                place, key, doc, bucket = place[order], key[order], doc[order], bucket[order]
                out = []
                heads = _heads(bucket)
                for a, b in zip(heads, np.append(heads, len(bucket))[1:], strict=True):
                    runs = _heads(doc[a:b])
                    out.append([int(bucket[a]), key[a:b].tobytes(), place[a:b].astype("<u4").tobytes(), doc[a:b][runs], np.diff(np.append(runs, b - a)).astype(np.int32)])
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.mapInArrow(run, "bucket int, keys binary, places binary, docs array<bigint>, counts array<int>")


def _collisions(entries: DataFrame) -> DataFrame:
    """(x, y, hits) of documents that share a key, each with the smallest document of that key, and the places of those
    keys that three or more documents have; and in rows of their own (key, x, docs, places) all places of such a key."""

    def run(table: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<i8")
        place = np.frombuffer(b"".join(table.column("places").to_pylist()), "<u4").astype(np.int64)
        doc = np.repeat(*(table.column(c).combine_chunks().flatten().to_numpy() for c in ("docs", "counts")))
        # keys that stand once collide with nothing, so only the others are put in order of document and place
        order = np.argsort(key)
        heads = _heads(key[order])
        sizes = np.diff(np.append(heads, len(key)))
        order = order[np.repeat(sizes > 1, sizes)]
        key, place, doc = key[order], place[order], doc[order]
        order = np.lexsort((place, doc, key))
        key, place, doc = key[order], place[order], doc[order]
        heads = _heads(key)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        different = np.bincount(group[_heads(key, doc)], minlength=len(heads))
        pivot = doc[heads][group]
        member = np.flatnonzero(pivot != doc)
        hits = np.zeros(len(member), HIT)
        hits["key"], hits["place"] = key[member], place[member]
        x, y, many = pivot[member], doc[member], different[group[member]] > 2
        order = np.lexsort((y, x))
        x, y, many, hits = x[order], y[order], many[order], hits[order]
        at = _heads(x, y)
        found = [(int(x[a]), int(y[a]), hits[a:b][many[a:b]].tobytes(), None, None, None) for a, b in zip(at, np.append(at, len(x))[1:], strict=True)]
        ends = np.append(heads, len(key))[1:]
        for g in np.flatnonzero(different > 2):
            a, b = heads[g], ends[g]
            found.append((int(doc[a]), None, None, int(key[a]), doc[a:b], place[a:b]))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 6, kinds, strict=True)], names=["x", "y", "hits", "key", "docs", "places"])

    return entries.groupBy("bucket").applyInArrow(run, "x long, y long, hits binary, key long, docs array<bigint>, places array<bigint>")


def _rising(values: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly rising subsequence."""
    if (np.diff(values) > 0).all():
        return np.arange(len(values))
    tops: list[int] = []
    at: list[int] = []
    before = []
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], np.int64)


def _distinct(values: np.ndarray) -> int:
    ranked = np.sort(values)
    return int((ranked[1:] != ranked[:-1]).sum()) + 1 if len(ranked) else 0


def _similarity(sx: np.ndarray, sy: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sets of tokens."""
    union = _distinct(np.concatenate([sx, sy]))
    return _distinct(sx) + _distinct(sy) - union, union


def _padded(lo: int, hi: int, n: int, window: int) -> tuple[int, int]:
    hi = max(hi, min(n, lo + window))
    return max(0, min(lo, hi - window)), hi


def _runs(jx: np.ndarray, iy: np.ndarray, percent: int, window: int) -> list[tuple[int, int]]:
    """(first, last) matches of runs of aligned matches that hold the similarity if all between are different tokens, the
    longest first and then those beside it; sides shorter than `window` count as filled up with others."""
    out, todo = [], [(0, len(jx))]
    g = (100 + percent) * np.arange(len(jx)) - percent * (jx + iy)
    least_both = -(-2 * percent * window // (100 + percent))
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least_both:
            continue
        begin = lo + np.searchsorted(-np.minimum.accumulate(g[lo:hi]), -(g[lo:hi] + 100 - percent))
        size = np.minimum(jx[lo:hi] - jx[begin], iy[lo:hi] - iy[begin]) + 1
        e = int(size.argmax())
        if size[e] >= window:
            s, e = int(begin[e]), lo + e
        else:
            best = None
            for n in range(least_both, min(hi - lo, window) + 1):
                s = np.arange(lo, hi - n + 1)
                sides = np.maximum(window, jx[s + n - 1] - jx[s] + 1) + np.maximum(window, iy[s + n - 1] - iy[s] + 1)
                fits = np.flatnonzero((100 + percent) * n >= percent * sides)
                if len(fits):
                    best = int(s[fits[0]]), int(s[fits[0]]) + n - 1
            if best is None:
                continue
            s, e = best
        out.append((s, e))
        todo += [(lo, s), (e + 1, hi)]
    return out


def _spare(percent: int, window: int) -> int:
    """Tokens that `window` neighbours of either side of a passage lack on the other, at most, together, where each side's
    best neighbours are taken.

    m common tokens leave (100 - percent) / percent * m others. They cost most if they stand in the middle of both sides
    and the runs of common tokens beside them are shorter than the window.
    """
    return max(min((100 - percent) * m // percent, 2 * max(0, window - m // 2)) for m in range(window // 2, 2 * window + 1))


def _places(tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(j, i): for every place i of y whose token x has, a place j of x with it; of several, the one nearest to the
    diagonal of the tokens around that x has once."""
    order = np.argsort(tx, kind="stable")
    ranked = tx[order]
    lo, hi = np.searchsorted(ranked, ty, side="left"), np.searchsorted(ranked, ty, side="right")
    i = np.flatnonzero(hi > lo)
    j = order[lo[i]]
    several = np.flatnonzero(hi[i] - lo[i] > 1)
    if len(several):
        once = np.flatnonzero(hi[i] - lo[i] == 1)
        k = np.searchsorted(once, several)
        shift = np.zeros(len(several), np.int64)
        if len(once):
            left, right = once[np.maximum(k - 1, 0)], once[np.minimum(k, len(once) - 1)]
            near = np.where(np.abs(i[left] - i[several]) <= np.abs(i[right] - i[several]), left, right)
            shift = j[near] - i[near]
        n = len(tx) + len(ty) + 1
        rank = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        want = rank[lo[i[several]]] * n + np.clip(i[several] + shift, 0, n - 1)
        have = rank * n + order
        right = np.minimum(np.searchsorted(have, want), len(have) - 1)
        left = np.maximum(right - 1, 0)
        own = want // n
        far = np.int64(1) << 62
        gap_r = np.where(have[right] // n == own, np.abs(have[right] - want), far)
        gap_l = np.where(have[left] // n == own, np.abs(have[left] - want), far)
        j[several] = np.where(gap_r <= gap_l, have[right], have[left]) % n
    return j, i


def _by_sets(tx: np.ndarray, ty: np.ndarray, shared: np.ndarray, covered: np.ndarray, percent: int, window: int) -> list[tuple[int, ...]]:
    """Boxes where tokens stand in another order: of places of y not covered, the `window` neighbours that x has most of,
    with the neighbours of x that have most of them, grown while that holds the similarity. shared: the places of y whose
    token x has."""
    out = []
    free = ~covered
    if (100 + percent) * free.sum() < 2 * percent * window:
        return out
    had = np.zeros(len(ty), bool)
    had[shared] = True
    free &= had
    while True:
        total = np.concatenate([[0], np.cumsum(free)])
        got = total[window:] - total[:-window]
        if not len(got) or (100 + percent) * got.max() < 2 * percent * window:
            return out
        c = int(got.argmax())
        inside = np.isin(tx, ty[c : c + window])
        total = np.concatenate([[0], np.cumsum(inside)])
        got = total[window:] - total[:-window]
        a = int(got.argmax())
        b, d = a + window, c + window
        both, union = _similarity(tx[a:b], ty[c:d])
        if 100 * both >= percent * union:
            out.append((a, b, c, d, both, union))
        free[c:d] = False


def passages(tx: np.ndarray, ty: np.ndarray, percent: int = SIMILARITY, window: int = WINDOW) -> list[tuple[int, ...]]:
    """(a, b, c, d, both, union): tokens a to b of x and c to d of y whose sets hold the similarity, all that can be aligned,
    and the sizes of the sets' intersection and union.

    Matches are put in the order of both texts, and runs of them taken, longest first; what is left is aligned again until
    nothing is found, so passages that stand in another order are found too. Last come stretches by sets.
    """
    out: list[tuple[int, ...]] = []
    jx, iy = _places(tx, ty)
    covered = np.zeros(len(ty), bool)
    while True:
        left = np.flatnonzero(~covered[iy])
        chain = left[_rising(jx[left])] if len(left) else left
        found = False
        for s, e in _runs(jx[chain], iy[chain], percent, window):
            a, b = _padded(int(jx[chain[s]]), int(jx[chain[e]]) + 1, len(tx), window)
            c, d = _padded(int(iy[chain[s]]), int(iy[chain[e]]) + 1, len(ty), window)
            both, union = _similarity(tx[a:b], ty[c:d])
            if 100 * both >= percent * union:
                out.append((a, b, c, d, both, union))
                covered[c:d] = found = True
        if not found:
            break
    return out + _by_sets(tx, ty, iy, covered, percent, window)


def near_passages_of(sx: np.ndarray, ox: np.ndarray, sy: np.ndarray, oy: np.ndarray, percent: int = SIMILARITY, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(pair, a, b, c, d, similarity) of all passages of pairs of texts, given as tokens and offsets of both sides.

    All pairs at once: those whose whole texts hold the similarity are one passage; those of which one side has no
    `window` neighbours with few enough tokens that the other lacks have none. The others are aligned one by one.
    """
    n = len(ox) - 1
    nx, ny = np.diff(ox), np.diff(oy)
    pair = np.concatenate([np.repeat(np.arange(n), nx), np.repeat(np.arange(n), ny)])
    h = np.concatenate([sx, sy]) + mix(pair.astype(U64), 7)
    side = np.arange(len(h)) >= len(sx)
    order = np.argsort(h)
    heads = _heads(h[order])
    counts = np.diff(np.append(heads, len(h)))
    on_y = np.add.reduceat(side[order].astype(np.int64), heads) if len(heads) else heads
    shared = (on_y > 0) & (on_y < counts)
    of = pair[order[heads]]
    both = np.bincount(of[shared], minlength=n)
    union = np.bincount(of, minlength=n)
    whole = (100 * both >= percent * union) & (nx >= window) & (ny >= window)
    # places whose token the other side lacks, where it stands first (sets are compared)
    lacks = np.zeros(len(h), bool)
    lacks[np.minimum.reduceat(order, heads)[~shared] if len(heads) else heads] = True
    least = np.zeros(n, np.int64)
    for lo, cuts in ((0, ox), (len(sx), oy)):
        total = np.concatenate([[0], np.cumsum(lacks[lo : lo + cuts[-1]])])
        start = _starts(cuts, window)
        own = np.full(n, len(h) + 1)
        if len(start):
            text = np.searchsorted(cuts, start, side="right") - 1
            head = _heads(text)
            own[text[head]] = np.minimum.reduceat(total[start + window] - total[start], head)
        least += own
    # all that a stretch of a passage lacks, its passage lacks too: (100 - percent) / percent of what is in common at most
    able = (least <= _spare(percent, window)) & (percent * least <= (100 - percent) * both)
    w = np.flatnonzero(whole)
    out = [np.column_stack([w, np.zeros(len(w), np.int64), nx[w], np.zeros(len(w), np.int64), ny[w], both[w], union[w]])]
    for i in np.flatnonzero(able & ~whole).tolist():
        tx, ty = sx[ox[i] : ox[i + 1]], sy[oy[i] : oy[i + 1]]
        rows = [(i, *box) for box in passages(tx, ty, percent, window)]
        if rows:
            out.append(np.array(rows, np.int64))
    got = np.concatenate(out)
    return (*got[:, :5].T, got[:, 5] / got[:, 6])


_FOUND = "x long, y long, a int, b int, c int, d int, similarity double"


def _found(x: np.ndarray, y: np.ndarray, rows: tuple[np.ndarray, ...]) -> list[pa.Array]:
    p, *box, similarity = rows
    return [pa.array(x[p], pa.int64()), pa.array(y[p], pa.int64()), *(pa.array(v.astype(np.int32)) for v in box), pa.array(similarity, pa.float64())]


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The passages (x, y, a, b, c, d, similarity) of all pairs (x, y).

    Each text of y goes to the text of x once. A document with many partners is dealt out with PARTNERS of them at a time.
    """
    spark = pairs.sparkSession
    degree = stored(pairs.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("salts")), "degree")
    small = pairs.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda df: df
    ys = pairs.join(hint(degree), "x").select("x", "y", F.pmod(F.xxhash64("y"), "salts").cast("int").alias("salt"))
    xs = degree.select("x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left = docs.select(F.col("d").alias("y"), F.col("t").alias("ty")).join(hint(ys), "y")
    right = docs.select(F.col("d").alias("x"), F.col("t").alias("tx")).join(hint(xs), "x")
    joined = left.join(right, ["x", "salt"]).select("x", "y", "tx", "ty")
    names = ["x", "y", "a", "b", "c", "d", "similarity"]

    def run(batches):
        for batch in batches:
            for part in (p for wide in slices(batch, "tx", PART_BYTES) for p in slices(wide, "ty", PART_BYTES)):
                found = near_passages_of(*tokens(*utf8(part.column("tx"))), *tokens(*utf8(part.column("ty"))))
                yield pa.RecordBatch.from_arrays(_found(part.column("x").to_numpy(), part.column("y").to_numpy(), found), names=names)

    return joined.mapInArrow(run, _FOUND)


def _unsettled(pairs: DataFrame, verified: DataFrame) -> DataFrame:
    """(key, d, place): places of keys of three or more documents that lie in no passage with their key's smallest one."""
    spans = verified.groupBy("x", "y").agg(F.collect_list("c").alias("c"), F.collect_list("d").alias("d"))
    rows = pairs.where(F.octet_length("hits") > 0).join(spans, ["x", "y"], "left").select("y", "hits", "c", "d")

    def run(batches):
        for batch in batches:
            key, doc, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for y, raw, lo, hi in zip(batch.column("y").to_pylist(), batch.column("hits").to_pylist(), batch.column("c").to_pylist(), batch.column("d").to_pylist(), strict=True):
                hit = np.frombuffer(raw, HIT)
                if lo:
                    edge = np.zeros(max(int(hit["place"].max()) + 2, max(hi) + 1), np.int64)
                    np.add.at(edge, lo, 1)
                    np.subtract.at(edge, hi, 1)
                    hit = hit[np.cumsum(edge)[hit["place"]] == 0]
                key.append(hit["key"])
                place.append(hit["place"].astype(np.int64))
                doc.append(np.full(len(hit), y))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (key, doc, place)], names=["key", "d", "place"])

    return rows.mapInArrow(run, "key long, d long, place long")


def _around(rows: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """rows (key, d, place, free) with what surrounds each place, WINDOW - 1 tokens on either side: where that begins, the
    place in it, its length, and two hashes of it or (whole) the tokens themselves."""
    packed = rows.groupBy("d").agg(F.collect_list(F.struct("key", "place", "free")).alias("at"))
    joined = texts.join(packed, "d").select("d", "t", "at")
    names = ["key", "d", "place", "free", "begin", "own", "n", *(["around"] if whole else ["h", "g"])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                token, cuts = tokens(*utf8(part.column("t")))
                at = part.column("at")
                owner = np.repeat(np.arange(part.num_rows), at.value_lengths().to_numpy())
                flat = at.flatten()
                place = flat.field("place").to_numpy()
                good = np.flatnonzero(place < np.diff(cuts)[owner])  # a row that repeats a doc_id may not be the one meant
                owner, place, flat = owner[good], place[good], flat.take(pa.array(good))
                lo = np.maximum(place - WINDOW + 1, 0)
                hi = np.minimum(place + WINDOW, np.diff(cuts)[owner])
                base = cuts[:-1][owner]
                if whole:
                    raw = (token << U64(64 - 8 * TOKEN_BYTES)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
                    last = [pa.array([raw[s:e].tobytes() for s, e in zip(base + lo, base + hi, strict=True)], pa.binary())]
                else:
                    last = []
                    for seed in (5, 6):
                        prefix = np.concatenate([np.zeros(1, U64), np.cumsum(mix(token, seed) * powers(BASE, len(token)))])
                        h = mix((prefix[base + hi] - prefix[base + lo]) * powers(BASE_INV, len(token) + 1)[base + lo])
                        last.append(pa.array(h.view(np.int64)))
                numbers = [pa.array(v.astype(np.int32)) for v in (lo, place - lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([flat.field("key"), part.column("d").take(pa.array(owner)), flat.field("place"), flat.field("free"), *numbers, *last], names=names)

    return joined.mapInArrow(run, "key long, d long, place long, free boolean, begin int, own int, n int, " + ("around binary" if whole else "h long, g long"))


def _linked_within(rows: DataFrame, bins: int) -> DataFrame:
    """The passages that join places of one key that no passage joins yet: rows of _around, blocks as dealt for each key.

    Places that are not free lie in a passage with the key's smallest document, so they are one class; every free one is a
    class of its own. A free place is held against all places of other classes until it joins them: their tokens are
    compared as whole arrays first, and passages verified where they can be (what WINDOW neighbours of both sides lack
    on the other, a passage around them lacks too, so it is bounded by what the sides have in common). A key of many places is dealt out as pairs
    of blocks of about BLOCK, so no task sees a whole large one; small keys come in `bins`, many at a time.
    """
    rows = rows.withColumn("i", F.pmod(F.xxhash64("d", "begin"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = F.when(F.col("blocks") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(bins)))
    rows = rows.select(bins.alias("bin"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "key", "d", "begin", "own", "free", "around")
    most = _spare(SIMILARITY, WINDOW)
    least_both = -(-2 * SIMILARITY * WINDOW // (100 + SIMILARITY))
    width = 2 * WINDOW - 1

    def lacking(lacks: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The least number of lacking ones among WINDOW neighbours of each row, all of them tokens."""
        total = np.zeros((len(lacks), width + 1), np.uint8)
        np.cumsum(lacks, axis=1, dtype=np.uint8, out=total[:, 1:])
        full = np.zeros((len(lacks), width + 1), np.uint8)
        np.cumsum(~inside, axis=1, dtype=np.uint8, out=full[:, 1:])
        return np.where(full[:, WINDOW:] == full[:, :-WINDOW], total[:, WINDOW:] - total[:, :-WINDOW], np.uint8(255)).min(axis=1)

    def possible(at: np.ndarray) -> np.ndarray:
        """Of rows whose tokens are all different, with the place of each in another such row (-1: none): those with a
        passage, and those whose tokens stand in another order there."""
        counts = (at >= 0).sum(axis=1)
        y = np.argsort(at < 0, axis=1, kind="stable")[:, : counts.max()].astype(np.int16)
        x = np.take_along_axis(at, y.astype(np.int64), axis=1)
        valid = np.arange(y.shape[1]) < counts[:, None]
        unordered = ((np.diff(x, axis=1) <= 0) & valid[:, 1:]).any(axis=1)
        s, e = np.triu_indices(y.shape[1], least_both - 1)
        n = (e - s + 1).astype(np.int16)
        sides = np.maximum(WINDOW, x[:, e] - x[:, s] + 1) + np.maximum(WINDOW, y[:, e] - y[:, s] + 1)
        fits = ((100 + SIMILARITY) * n >= SIMILARITY * sides) & valid[:, e]
        return fits.any(axis=1) | unordered

    def able(local: np.ndarray, inside: np.ndarray, firsts: np.ndarray, plain: np.ndarray, rs: np.ndarray, vs: np.ndarray) -> np.ndarray:
        """Which pairs of rows (rs ascending, vs) can have a passage; it makes no difference which of both comes first."""
        outside = int(local[inside].max()) + 1
        local = np.where(inside, local, outside)
        good = []
        for lo in range(0, len(rs), PAIR_ROWS):
            r, v = rs[lo : lo + PAIR_ROWS], vs[lo : lo + PAIR_ROWS]
            of = np.cumsum(np.append(0, r[1:] != r[:-1]))
            own = r[_heads(r)]
            at_of = np.full((len(own), outside + 1), -1, np.int16)
            at_of[np.arange(len(own))[:, None], local[own]] = np.arange(width)
            at_of[:, outside] = -1
            at_first = np.zeros((len(own), outside + 1), np.int16)
            row, column = np.nonzero(firsts[own])
            at_first[row, local[own[row], column]] = column
            at = at_of[of[:, None], local[v]]
            common = ((at >= 0) & firsts[v]).sum(axis=1)
            both = plain[v] & plain[r]
            keep = np.flatnonzero((common >= least_both) | ((common > 0) & ~both))
            at, common, both = at[keep], common[keep], both[keep]
            lacks = lacking((at < 0) & firsts[v[keep]], inside[v[keep]]).astype(np.int64)
            some = np.flatnonzero(SIMILARITY * lacks <= (100 - SIMILARITY) * common)
            keep, at, common, both, lacks = keep[some], at[some], common[some], both[some], lacks[some]
            mine = firsts[r[keep]]
            row, column = np.nonzero(at >= 0)
            mine[row, at_first[of[keep[row]], local[v[keep[row]], column]]] = False
            lacks += lacking(mine, inside[r[keep]])
            some = np.flatnonzero((lacks <= most) & (SIMILARITY * lacks <= (100 - SIMILARITY) * common))
            keep, at, both = keep[some], at[some], np.flatnonzero(both[some])
            fits = np.ones(len(keep), bool)
            for k in range(0, len(both), 128):
                fits[both[k : k + 128]] = possible(at[both[k : k + 128]])
            good.append(lo + keep[fits])
        return np.concatenate(good) if good else np.zeros(0, np.int64)

    def within(table: pa.Table) -> list[tuple]:
        """Of whole keys, one after another."""
        key, d, begin, own, free = (table.column(c).to_numpy() for c in ("key", "d", "begin", "own", "free"))
        data, cuts = utf8(table.column("around"))
        lengths = np.diff(cuts) // TOKEN_BYTES
        ends = np.cumsum(lengths)
        starts = ends - lengths
        found: list[tuple] = []
        heads = _heads(key)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        root = np.arange(len(d))
        settled = np.flatnonzero(~free)
        first = np.full(len(heads), len(d))
        np.minimum.at(first, group[settled], settled)
        root[settled] = first[group[settled]]

        wide = np.zeros((len(data) // TOKEN_BYTES, 8), np.uint8)
        wide[:, 8 - TOKEN_BYTES :] = data.reshape(-1, TOKEN_BYTES)
        owner = np.repeat(np.arange(len(d)), lengths)
        names, code = np.unique(wide.view(">u8").reshape(-1).astype(U64) | group[owner].astype(U64) << U64(8 * TOKEN_BYTES), return_inverse=True)
        place = np.arange(len(code)) - starts[owner] + (WINDOW - 1 - own[owner])
        around = np.full((len(d), width), len(names), np.int32)
        around[owner, place] = code
        inside = around < len(names)
        # where a token stands first in its row (sets are compared), and tokens that no other row of the key has
        ranked = np.sort(around.astype(np.int64) * width + np.arange(width), axis=1)
        new = np.ones(ranked.shape, bool)
        new[:, 1:] = ranked[:, 1:] // width != ranked[:, :-1] // width
        firsts = np.zeros(ranked.shape, bool)
        np.put_along_axis(firsts, ranked % width, new, axis=1)
        firsts &= inside
        plain = (firsts == inside).all(axis=1)
        lone = np.append(np.bincount(around[firsts], minlength=len(names)) < 2, True)
        some = np.flatnonzero(lacking(lone[around] & firsts, inside) <= most)
        some = some[np.isin(group[some], group[some[free[some]]])]
        if not len(some):
            return found
        around, inside, firsts, plain = around[some], inside[some], firsts[some], plain[some]
        # tokens by their number in their key
        bases = np.searchsorted(names >> U64(8 * TOKEN_BYTES), np.arange(len(heads) + 1, dtype=U64))
        local = around - bases[group[some]][:, None]

        def join(r: int, v: int) -> None:
            k, m = some[r], some[v]
            if root[m] == root[k]:
                return
            (tx, x), (ty, y) = ((code[starts[w] : ends[w]], w) for w in ((k, m) if d[k] < d[m] else (m, k)))
            boxes = passages(tx, ty)
            for a, b, c, e, shared, union in boxes:
                found.append((d[x], d[y], begin[x] + a, begin[x] + b, begin[y] + c, begin[y] + e, shared / union))
            if boxes:
                own_root, (lo, hi) = root[m], edges[group[k]]
                root[lo:hi][root[lo:hi] == own_root] = root[k]

        edges = np.column_stack([heads, np.append(heads, len(key))[1:]])
        cuts = np.append(_heads(group[some]), len(some))
        sizes = np.diff(cuts)
        # keys of few places: all their pairs at once; a pair of free places counts once
        few = np.flatnonzero(sizes <= FEW_PLACES)
        at = ragged(cuts[few], sizes[few])
        left = np.repeat(at, np.repeat(sizes[few], sizes[few]))
        right = ragged(np.repeat(cuts[few], sizes[few]), np.repeat(sizes[few], sizes[few]))
        pick = np.flatnonzero(free[some[left]] & (~free[some[right]] | (right > left)) & (d[some[left]] != d[some[right]]))
        left, right = left[pick], right[pick]
        if len(left):
            take = np.unique(np.concatenate([left, right]))
            pick = able(local[take], inside[take], firsts[take], plain[take], np.searchsorted(take, left), np.searchsorted(take, right))
            for r, v in zip(left[pick].tolist(), right[pick].tolist(), strict=True):
                join(r, v)
        # of many: one place after another, each only against places that it does not hang together with yet
        for lo, hi in zip(cuts[:-1][sizes > FEW_PLACES].tolist(), cuts[1:][sizes > FEW_PLACES].tolist(), strict=True):
            own = some[lo:hi]
            for r in np.flatnonzero(free[own]).tolist():
                rest = np.flatnonzero((root[own] != root[own[r]]) & (d[own] != d[own[r]]) & (~free[own] | (np.arange(hi - lo) > r)))
                for v in rest[able(local[lo:hi], inside[lo:hi], firsts[lo:hi], plain[lo:hi], np.full(len(rest), r), rest)].tolist():
                    join(lo + r, lo + v)
        return found

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key").combine_chunks()
        heads = _heads(table.column("key").to_numpy())
        cuts = [0]
        for a, b in zip(heads.tolist(), np.append(heads, table.num_rows)[1:].tolist(), strict=True):
            if a > cuts[-1] and b - cuts[-1] > PLACES:
                cuts.append(a)
        cuts.append(table.num_rows)
        found = [row for a, b in zip(cuts[:-1], cuts[1:], strict=True) for row in within(table.slice(a, b - a))]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 7, kinds, strict=True)], names=["x", "y", "a", "b", "c", "d", "similarity"])

    return rows.groupBy("bin", "lo", "hi").applyInArrow(run, _FOUND)


def _regrouped(found: DataFrame, unsettled: DataFrame, docs: DataFrame) -> DataFrame:
    """The passages that join unsettled places to others of their key. Places of a key with the same surroundings are
    joined to one of them, a settled one if there is one, and only that one is held against others."""
    marked = unsettled.distinct().withColumn("open", F.lit(True))
    open_keys = stored(unsettled.select("key").distinct(), "keys")
    hint = F.broadcast if open_keys.count() <= BROADCAST_ROWS else lambda df: df
    places = found.where("key is not null").join(hint(open_keys), "key").select("key", F.explode(F.arrays_zip("docs", "places")).alias("m")).select("key", F.col("m.docs").alias("d"), F.col("m.places").alias("place"))
    places = stored(places.join(marked, ["key", "d", "place"], "left").select("key", "d", "place", F.coalesce("open", F.lit(False)).alias("free")), "places")
    ids = stored(places.select("d").distinct(), "ids")
    hint = F.broadcast if ids.count() <= BROADCAST_ROWS else lambda df: df
    texts = stored(docs.join(hint(ids), "d", "left_semi"), "texts")
    alike = ["key", "own", "n", "h", "g"]
    hashed = stored(_around(places, texts, whole=False), "surroundings")
    firsts = stored(hashed.groupBy(*alike).agg(F.min(F.struct("free", "d", "place", "begin")).alias("m")).select(*alike, "m.*"), "surroundings")
    same = hashed.where(f"free and n >= {WINDOW}").join(firsts.select(*alike, F.col("d").alias("first"), F.col("begin").alias("first_begin")), alike).where("d <> first")
    side = lambda at: [F.when(F.col("d") > F.col("first"), F.col("first_begin" if at else "begin")).otherwise(F.col("begin" if at else "first_begin")).alias("s")]
    (sx,), (sy,) = side(True), side(False)
    linked = same.select(F.least("d", "first").alias("x"), F.greatest("d", "first").alias("y"), sx.alias("a"), (sx + F.col("n")).alias("b"), sy.alias("c"), (sy + F.col("n")).alias("d"), F.lit(1.0).alias("similarity"))
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("free").alias("f")).where("n > 1 and f").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    several = stored(several, "keys")
    hint = F.broadcast if several.count() <= BROADCAST_ROWS else lambda df: df
    compared = _around(firsts.join(hint(several.select("key")), "key", "left_semi").select("key", "d", "place", "free"), texts, whole=True).join(hint(several), "key")
    return linked.union(_linked_within(compared, partitions_for(several.count(), BIN_KEYS, BUCKETS)))


def near_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, match_doc_id, match_start, match_end, similarity): near-duplicate passages of two documents.

    Words start to end (end not included) of a document and of one with a smaller id whose sets of 5-word shingles have
    the similarity SIMILARITY per cent or more; both have PASSAGE words at least. Words are lower-cased runs of anything
    but ASCII white space. Documents with the same text are paired with the smallest of them, which stands for all. Of
    documents that share a key of their windows, each is paired with the smallest; a place that lies in no passage with
    it is held against all other places of the key, those that lie in one included, and joined to each class of
    them that it has a passage with, by one passage. So no group is expanded into all pairs, and all that passages lead to
    hang together. Texts with fewer words, null texts and rows without a doc_id have no passages. Rows that repeat a
    doc_id are not held against each other. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    _, size = text_stats(rows, "t")
    hashed = rows.withColumn("h", F.concat(F.md5("t"), F.length("t")))
    firsts = stored(hashed.groupBy("h").agg(F.min("d").alias("x"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("h", "x"), "copies")
    hint = F.broadcast if firsts.count() <= BROADCAST_ROWS else lambda df: df
    marked = hashed.join(hint(firsts), "h", "left")
    base = marked.where("x is null or d = x").select("d", "t")
    whole = marked.where("d <> x").select("x", "d", F.regexp_count("t", F.lit("[^\\x20\\x09-\\x0D]+")).cast("int").alias("n")).where(f"n >= {PASSAGE}")
    whole = whole.select("x", F.col("d").alias("y"), F.lit(0).alias("a"), (F.col("n") - SHINGLE + 1).alias("b"), F.lit(0).alias("c"), (F.col("n") - SHINGLE + 1).alias("d"), F.lit(1.0).alias("similarity"))

    found = stored(_collisions(_entries(base, partitions_for(size, BUCKET_BYTES, BUCKETS))), "collisions")
    pairs = found.where("y is not null").select("x", "y", "hits")
    verified = stored(_verify(stored(pairs.select("x", "y").distinct(), "pairs"), base), "passages")
    unsettled = stored(_unsettled(pairs, verified), "unsettled")
    out = verified.union(_regrouped(found, unsettled, base)).union(whole)
    words_of = lambda lo, hi: [F.col(lo).cast("long"), (F.col(hi) + SHINGLE - 1).cast("long")]
    (s, e), (ms, me) = words_of("c", "d"), words_of("a", "b")
    return out.select(F.col("y").alias("doc_id"), s.alias("start"), e.alias("end"), F.col("x").alias("match_doc_id"), ms.alias("match_start"), me.alias("match_end"), "similarity").distinct()


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate passages of all documents; see near_passages."""
    bounded_batches(spark)
    return near_passages(documents(spark, sf_dir))
