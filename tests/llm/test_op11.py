import hashlib
import random
import zlib

import pytest

from pulsespark.llm import op11_trie as op


def brute(rows, rebuild=True):
    """Dictionary of prefixes; rows are (conv_id, turn, role, text) without equal turns in a conversation."""
    convs = {}
    for c, u, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:]) if rebuild else tuple(own)
    nodes = {}
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = {}
    for p, members in sorted(nodes.items(), key=lambda x: -len(x[0])):
        kids = [q for q in out if len(q) == len(p) + 1 and q[: len(p)] == p]
        saved = (len(members) - 1) * (len(p[-1][1]) if p else 0) + sum(out[q][6] for q in kids)
        ids = ",".join(str(c) for c in members if built[c] == p)
        out[p] = (members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(kids), sum(out[q][5] for q in kids) or 1, saved, hashlib.sha256(ids.encode()).hexdigest())
    return sorted(out.values(), key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as c", "2 as pos", "'x' as k", "3 as size", "4 as cls", "5 as id")


def rows_of(df):
    assert [f.name for f in df.schema] == [f.split()[0] for f in op.OUT.split(", ")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, first=0):
    r = random.Random(seed)
    rows = []
    for c in range(first, first + n):
        seen = []
        for u in range(r.randrange(1, 9)):
            role, text = r.choice([("user", "a"), ("user", "bb"), ("bot", "a"), (None, None), ("bot", "ccc")][: 1 + r.randrange(5)])
            seen.append((c, u if u or r.random() < 0.5 else None, role, text))
        rows += seen
    return rows


@pytest.mark.parametrize("small", [0, 7, 60, 10**6])
def test_as_by_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(op, "BUFFER", 50)
    rows = made(small, 130, 150) + [(None, 1, "user", "lost"), (7, None, "x", "y")]
    assert rows_of(op.prefix_trie(*op.with_shared_heads(table(spark, rows)), small=small)) == brute(rows)


def test_plain_conversations_and_one_that_is_long(spark):
    rows = made(5, 40) + [(900, u, "user", f"t{u % 7}") for u in range(400)] + [(901, u, "user", f"t{u % 7}") for u in range(390)]
    for small in (900, 10**6):
        assert rows_of(op.prefix_trie(*op.plain(table(spark, rows)), small=small)) == brute(rows, rebuild=False)


def test_copies_in_one_class(spark):
    rows = [(c, u, "user", "same text") for c in range(300) for u in range(3)] + [(1000, 0, "user", "other")]
    got = rows_of(op.prefix_trie(*op.plain(table(spark, rows)), small=100))
    assert got == brute(rows, rebuild=False)
    assert max(r[3] for r in got) == 301


def test_one_conversation_and_none(spark):
    rows = [(3, 1, "user", "a" * 100000), (3, 2, None, "")]
    for small in (0, 100):
        assert rows_of(op.prefix_trie(*op.plain(table(spark, rows)), small=small)) == brute(rows, rebuild=False)
    assert rows_of(op.prefix_trie(*op.with_shared_heads(table(spark, [])))) == []


def test_repeated_rows_are_turns_and_their_order_is_fixed(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "bot", "b"), (2, 0, "bot", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    got = rows_of(op.prefix_trie(*op.plain(table(spark, rows))))
    assert [r[1:4] for r in sorted(got, key=lambda r: r[1])] == [(0, None, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2)]


def test_whole_table_as_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{path}/conversations.parquet')")
    names = [f.split()[0] for f in op.OUT.split(", ")]
    want = sorted(con.sql(f"select {', '.join(names)} from ({op.SQL})").fetchall(), key=str)
    assert rows_of(op.op11_trie(spark, path)) == want
    assert brute(spark.read.parquet(f"{path}/conversations.parquet").collect()) == want
