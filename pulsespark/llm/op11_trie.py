"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. Turn by turn, each active class is split by its members' next turn; a class is a
node of the trie. A class of one member retires: the rest of its turns is a chain of nodes of one child each. Counts of
leaves and saved tokens are folded back from the deepest nodes to the root.

Classes that hold many turns (more than SMALL) are split by joins and combinable sums over all executors, a turn a round;
what is left of a small class is handed to one task, which splits it to its end. No class is gathered whole before it is
small, so a third of all conversations may share their turns, and a conversation's turns are numbered by ranges, so one
may hold a third of all turns.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import documents, ragged, stored, utf8

#: Members and turns of a class that one task splits to its end.
SMALL = 8192
#: Rows that such a task takes at once, at least.
BUFFER = 1 << 16
HEADS = 5
IDS_IN_CHUNK = 512
NO_IDS = hashlib.sha256(b"").hexdigest()
OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, part, id, k, chars), (c, part, lo, before, size)): turns dealt by ranges of their order, and where the turns of each
    conversation lie. A turn's number is id - lo + before + 1. k is a 128-bit hash of role and text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("u"), F.unhex(F.md5(F.concat(F.char_length(role), F.lit(":"), role, text))).alias("k"), F.char_length(text).cast("long").alias("chars"))
    dealt = rows.repartitionByRange(F.col("c"), F.col("u").asc_nulls_first(), F.col("k")).sortWithinPartitions(F.col("c"), F.col("u").asc_nulls_first(), F.col("k"))
    placed = stored(dealt.withColumn("id", F.monotonically_increasing_id()).select("c", F.shiftright("id", 33).alias("part"), "id", "k", "chars"), "turns")
    runs = placed.groupBy("c", "part").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n"))
    return placed, runs.selectExpr("c", "part", "lo", "sum(n) over (partition by c order by part) - n as before", "sum(n) over (partition by c) as size")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, pos, k, chars) of all turns, and (c, size) of all conversations, as they are."""
    placed, runs = numbered(turns)
    rows = placed.join(runs, ["c", "part"]).selectExpr("c", "id - lo + before + 1 as pos", "k", "chars")
    return _by_turn(rows), stored(runs.select("c", "size").distinct(), "sizes")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rebuilt conversations: the first h turns of conversation c - c % 100 (all if it has fewer, none if it is
    absent), then c's own turns after its first h, where h is crc32 of c in decimal, modulo 6."""
    placed, runs = numbered(turns)
    own = placed.join(runs, ["c", "part"]).selectExpr("c", "id - lo + before + 1 as pos", "k", "chars")
    heads = own.where(f"c % 100 = 0 and pos <= {HEADS}").groupBy(F.col("c").alias("head")).agg(F.array_sort(F.collect_list(F.struct("pos", "k", "chars"))).alias("turns"))
    convs = runs.groupBy("c").agg(F.first("size").alias("own")).withColumn("h", F.crc32(F.col("c").cast("string")) % 6)
    convs = stored(convs.withColumn("head", F.expr("c - c % 100")).join(heads, "head", "left").selectExpr("c", "own", "h", "slice(turns, 1, cast(h as int)) as turns").withColumn("taken", F.coalesce(F.size("turns"), F.lit(0))), "rebuilt")
    first = convs.select("c", F.explode("turns").alias("t")).select("c", "t.*")
    where = runs.join(convs.select("c", "h", "taken"), "c").drop("size")
    rest = placed.join(where, ["c", "part"]).withColumn("pos", F.expr("id - lo + before + 1")).where("pos > h").selectExpr("c", "pos - h + taken as pos", "k", "chars")
    return _by_turn(first.unionByName(rest)), convs.selectExpr("c", "taken + greatest(own - h, 0) as size")


def _by_turn(rows: DataFrame) -> DataFrame:
    """Stored by ranges of the turn's number, so that a round reads little more than its own turn."""
    return stored(rows.repartitionByRange("pos", "c").sortWithinPartitions("pos", "c"), "by_turn")


def prefix_trie(turns: DataFrame, sizes: DataFrame, small: int | None = None) -> DataFrame:
    """One row a node, of turns (c, pos, k, chars) and conversations (c, size) as `plain` and `with_shared_heads` give them.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves, saved_tokens
    (of the subtree: members less one, times the code points of the node's text), ends_sha256 (ids of the members that
    have no further turn, in decimal, ascending, joined by commas). No conversation gives no node. Work grows with the
    turns; there are as many rounds as turns that classes above `small` share.
    """
    small = SMALL if small is None else small
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("rows")).first()
    spark = turns.sparkSession
    if not total["n"]:
        return spark.createDataFrame([], OUT)
    root = spark.range(1).selectExpr(f"{total['c']}L as conv_id", "0L as depth", "cast(null as long) as parent_conv_id", f"{total['n']}L as n_convs", "0L as chars")
    active = sizes.select("c", "size", F.lit(total["c"]).cast("long").alias("cls"))
    if total["n"] + total["rows"] <= small:
        held = active.select("*", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("top_chars"))
        return _finish(held, turns).drop("top")
    large, alone, handed, ends, depth = [root], [], [], [], 0
    while True:
        ends.append(active.where(F.col("size") == depth).selectExpr("cls", f"{depth}L as depth", "c"))
        depth += 1
        step = active.where(F.col("size") >= depth).join(turns.where(F.col("pos") == depth).select("c", "k", "chars"), "c")
        split = step.groupBy("cls", "k").agg(F.min("c").alias("to"), F.count(F.lit(1)).alias("n"), F.sum(F.col("size") - depth + 1).alias("weight"), F.max("chars").alias("chars"))
        split = stored(split.withColumn("large", (F.col("n") > 1) & (F.col("weight") > small)), "classes")
        alone.append(split.where("n = 1").selectExpr("to as c", f"{depth}L as depth", "cls as parent", f"weight + {depth - 1} as size"))
        members = stored(step.drop("chars").join(split.where("n > 1"), ["cls", "k"]).select("c", "size", F.col("to").alias("cls"), F.col("cls").alias("parent"), F.col("chars").alias("top_chars"), "large"), "members")
        handed.append(members.where("not large").select("c", "size", "cls", F.lit(depth).cast("long").alias("depth"), "parent", "top_chars"))
        going = split.where("large")
        if not going.limit(1).count():
            break
        large.append(going.selectExpr("to as conv_id", f"{depth}L as depth", "cls as parent_conv_id", "n as n_convs", "chars"))
        active = members.where("large").select("c", "size", "cls")
    alone, handed = functools.reduce(DataFrame.union, alone), functools.reduce(DataFrame.union, handed)
    done = stored(_finish(handed, turns), "small")
    folded = _fold(large, done.where("top").selectExpr("parent_conv_id", "depth", "n_leaves", "saved_tokens").union(alone.selectExpr("parent", "depth", "1L", "0L")))
    ids = _id_hashes(functools.reduce(DataFrame.union, ends)).withColumnRenamed("cls", "conv_id")
    folded = folded.join(ids, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    order = [f.split()[0] for f in OUT.split(", ")]
    return folded.select(order).union(done.select(order)).union(_chains(alone, turns).select(order))


def _chains(alone: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of retired conversations: each turn from `depth` on is a node of one member."""
    last = F.col("pos") == F.col("size")
    return (
        turns.select("c", "pos")
        .join(alone, "c")
        .where("pos >= depth")
        .select(
            F.col("c").alias("conv_id"),
            F.col("pos").cast("long").alias("depth"),
            F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("c")).alias("parent_conv_id"),
            F.lit(1).cast("long").alias("n_convs"),
            F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(F.col("c").cast("string"), 256)).otherwise(F.lit(NO_IDS)).alias("ends_sha256"),
        )
    )


def _fold(large: list[DataFrame], below: DataFrame) -> DataFrame:
    """Large classes (by depth) with their children, leaves and saved tokens. below: (parent_conv_id, depth, n_leaves,
    saved_tokens) of the highest nodes that are not large."""
    done: list[DataFrame] = []
    for depth in range(len(large) - 1, -1, -1):
        under = below.where(F.col("depth") == depth + 1)
        if done:
            under = under.union(done[-1].select("parent_conv_id", "depth", "n_leaves", "saved_tokens"))
        sums = under.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        node = large[depth].join(sums, "conv_id", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
        done.append(stored(node, "folded"))
    return functools.reduce(DataFrame.union, done)


def _id_hashes(ends: DataFrame) -> DataFrame:
    """(cls, depth, ends_sha256): ids are joined in bounded chunks over ranges of (cls, depth, c) first, so that the one
    stream that a hash needs has few rows."""

    def join(batches):
        for batch in batches:
            cls, depth, c = (batch.column(k).to_numpy() for k in ("cls", "depth", "c"))
            fresh = np.ones(len(c), bool)
            fresh[1:] = (cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1])
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(c) else np.zeros(0, np.int64)
            starts = np.flatnonzero((np.arange(len(c)) - run) % IDS_IN_CHUNK == 0)
            ids = [",".join(map(str, c[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(c)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls[starts]), pa.array(depth[starts]), pa.array(c[starts]), pa.array(ids, pa.string())], names=["cls", "depth", "c", "ids"])

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            out: list[tuple] = []
            for cls, depth, ids in zip(batch.column("cls").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (cls, depth) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (cls, depth), hashlib.sha256(ids.encode())
            yield _hash_rows(out)
        if now:
            yield _hash_rows([(*now, sha.hexdigest())])

    order = ["cls", "depth", "c"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "cls long, depth long, c long, ids string")
    return chunks.repartition("cls", "depth").sortWithinPartitions(*order).mapInArrow(digest, "cls long, depth long, ends_sha256 string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    cls, depth, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], names=["cls", "depth", "ends_sha256"])


def _finish(members: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of small classes and below, of members (c, size, cls, depth, parent, top_chars). `top` marks the classes."""
    rest = turns.join(members.select("c", "cls", "depth"), "c").where("pos > depth").selectExpr("c", "cls", "depth", "pos", "k", "chars", "cast(null as long) as size", "cast(null as long) as parent")
    here = members.selectExpr("c", "cls", "depth", "depth as pos", "unhex(repeat('0', 32)) as k", "top_chars as chars", "size", "parent")
    rows = here.unionByName(rest).repartition("cls", "depth").sortWithinPartitions("cls", "depth", "pos", "c")

    def refine(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BUFFER:
                table = pa.Table.from_batches(held).combine_chunks()
                cls, depth = table["cls"].to_numpy(), table["depth"].to_numpy()
                whole = np.flatnonzero((cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1]))
                cut = int(whole[-1]) + 1 if len(whole) else 0
                if cut:
                    yield split_to_the_end(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                n -= cut
        if n:
            yield split_to_the_end(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(refine, OUT + ", top boolean")


def split_to_the_end(table: pa.Table) -> pa.RecordBatch:
    """Nodes of whole classes, sorted by (cls, depth, pos, c). Rows with pos = depth are the members (size, parent and
    the class's chars), the others their turns after that depth. All classes of the table are split at once, a turn a
    step."""
    cls, depth, pos, c, chars = (table[k].to_numpy() for k in ("cls", "depth", "pos", "c", "chars"))
    key = np.frombuffer(utf8(table["k"])[0].tobytes(), np.uint64).reshape(-1, 2)
    fresh = np.ones(len(c), bool)
    fresh[1:] = (cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1])
    group, tops = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    mark = np.flatnonzero(pos == depth)
    size = table["size"].take(pa.array(mark)).to_numpy().astype(np.int64)
    _, rank = np.unique(c, return_inverse=True)
    name = group * (int(rank.max()) + 1) + rank
    turn = np.flatnonzero(pos > depth)
    turn = turn[np.argsort(pos[turn] - depth[turn], kind="stable")]
    level = pos[turn] - depth[turn]
    member = np.searchsorted(name[mark], name[turn])

    at = group[mark].copy()
    going = np.bincount(at)[at] > 1
    nodes = {"conv": [cls[tops]], "depth": [depth[tops]], "n": [np.bincount(at)], "chars": [chars[tops]], "up": [np.full(len(tops), -1)]}
    starts, first = [0], len(tops)
    for lo, hi in zip(edges := np.flatnonzero(np.diff(level, prepend=0)), [*edges[1:], len(level)], strict=True):
        live = np.flatnonzero(going[member[lo:hi]]) + lo
        if not len(live):
            break
        m, row = member[live], turn[live]
        order = np.lexsort((c[row], key[row, 1], key[row, 0], at[m]))
        m, row = m[order], row[order]
        new = np.ones(len(m), bool)
        new[1:] = (at[m[1:]] != at[m[:-1]]) | (key[row[1:]] != key[row[:-1]]).any(1)
        begin = np.flatnonzero(new)
        n = np.diff(begin, append=len(m))
        for k, values in (("conv", c[row[begin]]), ("depth", pos[row[begin]]), ("n", n), ("chars", chars[row[begin]]), ("up", at[m[begin]])):
            nodes[k].append(values)
        at[m] = first + np.cumsum(new) - 1
        going[m] = np.repeat(n > 1, n)
        starts.append(first)
        first += len(begin)
    conv, deep, n, chars, up = (np.concatenate(nodes[k]) for k in ("conv", "depth", "n", "chars", "up"))
    tail = size - deep[at]  # turns of retired members that are no node yet
    tail[n[at] > 1] = 0
    children = np.bincount(up[up >= 0], minlength=len(conv))
    leaves, saved = (children == 0).astype(np.int64), (n - 1) * chars
    for lo, hi in list(zip(starts, [*starts[1:], len(conv)], strict=True))[:0:-1]:
        np.add.at(leaves, up[lo:hi], leaves[lo:hi])
        np.add.at(saved, up[lo:hi], saved[lo:hi])
    np.add.at(children, at[tail > 0], 1)
    sha = np.full(len(conv), NO_IDS, object)
    ended = np.flatnonzero(tail == 0)
    ended = ended[np.lexsort((c[mark[ended]], at[ended]))]
    for ids in np.split(ended, np.flatnonzero(np.diff(at[ended])) + 1):
        if len(ids):
            sha[at[ids[0]]] = hashlib.sha256(",".join(map(str, c[mark[ids]].tolist())).encode()).hexdigest()
    given = table["parent"].take(pa.array(tops)).to_pylist()
    parent = pa.array([*given, *conv[up[len(tops) :]].tolist()], pa.int64())
    # unary chains
    long = np.flatnonzero(tail > 0)
    who, down = np.repeat(long, tail[long]), ragged(deep[at[long]] + 1, tail[long])
    chain, last = c[mark[who]], down == size[who]
    own = [hashlib.sha256(str(x).encode()).hexdigest() if end else NO_IDS for x, end in zip(chain.tolist(), last.tolist(), strict=True)]
    one = np.ones(len(chain), np.int64)
    columns = [np.concatenate([conv, chain]), np.concatenate([deep, down]), pa.concat_arrays([parent, pa.array(chain, pa.int64())]), np.concatenate([n, one]), np.concatenate([children, (~last).astype(np.int64)]), np.concatenate([leaves, one]), np.concatenate([saved, 0 * one])]
    top = np.zeros(len(conv) + len(chain), bool)
    top[: len(tops)] = True
    return pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns), pa.array([*sha, *own], pa.string()), pa.array(top)], names=[f.split()[0] for f in OUT.split(", ")] + ["top"])


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`prefix_trie` of the rebuilt conversations.

    Turns are ordered by number, null first; equal numbers by a hash of role and text. Null roles and texts are empty.
    Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. Further columns are not read.
    """
    return prefix_trie(*with_shared_heads(documents(spark, sf_dir, "conversations")))


#: The same by prefixes as keys, one pass a depth: for DuckDB.
SQL = """
with recursive bits as (select range as i from range(256)),
tab as (select list(list_reduce([0,1,2,3,4,5,6,7,8], lambda a, x: case when x = 0 then a when a % 2 = 1 then xor(3988292384, a >> 1) else a >> 1 end, i::ubigint) order by i) as t from bits),
turns as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first) as p from conversations where conv_id is not null),
sizes as (select c, max(p) as own from turns group by c),
h as (select c, own, list_reduce(list_prepend(4294967295::ubigint, [ascii(s)::ubigint for s in string_split(c::varchar, '')]), lambda a, b: xor(t[1 + (xor(a, b) & 255)::bigint], a >> 8)) as crc from sizes, tab),
k as (select c, own, xor(crc, 4294967295) % 6 as h from h),
rebuilt as (
  select k.c, t.p as pos, t.r, t.x from k join turns t on t.c = k.c - k.c % 100 and t.p <= k.h
  union all
  select k.c, t.p - k.h + least(k.h, coalesce(b.own, 0)), t.r, t.x from k join turns t on t.c = k.c and t.p > k.h left join sizes b on b.c = k.c - k.c % 100),
lists as (select k.c, coalesce(list({'r': r.r, 'x': r.x} order by r.pos) filter (where r.pos is not null), []) as l from k left join rebuilt r on r.c = k.c group by k.c),
members as (select c, l, len(l) as size, unnest(range(len(l) + 1)) as depth from lists),
keyed as (select c, size, depth, sha256(to_json(l[:depth])::varchar) as key, sha256(to_json(l[:depth - 1])::varchar) as up, case when depth = 0 then 0 else length(l[depth].x) end as chars from members),
nodes as (select depth, key, any_value(up) as up, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where size = depth), '')) as ends_sha256 from keyed group by depth, key),
kids as (select p.depth, p.key, count(*) as n_children from nodes p join nodes n on n.depth = p.depth + 1 and n.up = p.key group by 1, 2),
tree as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, key)),
below as (select a.depth, a.key, count(*) filter (where t.n_children = 0) as n_leaves, sum((t.n_convs - 1) * t.chars) as saved_tokens
  from keyed a join keyed m on m.c = a.c and m.depth >= a.depth join tree t on t.depth = m.depth and t.key = m.key and t.conv_id = m.c group by 1, 2)
select t.conv_id, t.depth, p.conv_id as parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, t.ends_sha256
from tree t join below b using (depth, key) left join tree p on p.depth = t.depth - 1 and p.key = t.up and t.depth > 0
"""
