"""Spelling variants: words at distance one, by forward and backward minimal acyclic automata.

Cut a word in two halves. One error lies in the second half, then the other word starts with the first half; or in the
first half, then it ends with the second. So the first half is read exactly in an automaton of the words and the rest is
completed with one error; the same is done from the end in an automaton of the reversed words. The automata number their
words: the sum of what a path passes by is the place of its word in order.

An error may stand at several places of a run of equal letters (`too` and `to`). Only the last of them counts, in either
direction, so every near word is found once, by one path of one direction, and no pairs have to be made distinct.

The vocabulary is dealt by the half that must agree (forward the first, backward the last letters) over as many shards as it
needs; a word asks at most two halves a direction. A half with many words is dealt out further by the word, and then its
questions go to all its parts. Each shard builds its automaton in numpy and answers all its questions at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsespark.llm._common import LOWER, documents, mix, ragged, stored, utf8

MIN_CHARS = 5
MIN_COUNT = 3
CORRUPT = 97
#: Bytes of text of which occurrences are counted together.
STRETCH_BYTES = 8 << 20
#: Runs above so many bytes are hashed one by one.
LONG_RUN = 256
#: Words of a shard, about; a half that has more is dealt out.
SHARD_WORDS = 1 << 14
#: Questions that are answered together.
ASK = 1 << 13


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


CRC = _crc_table()
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def crc_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run of bytes, going on from the crc32 `before` it; a byte of all runs a step."""
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG_RUN))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = order[long:]
    state, at, left = ~before[order], starts[order], -size[order]
    for j in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -j))
        s = state[:n]
        state[:n] = CRC[(s ^ data[at[:n] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


def _stretches(data: np.ndarray, offsets: np.ndarray):
    """(first byte, end, row) of pieces of rows, at most STRETCH_BYTES long where a run doesn't reach over."""
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while end - at > STRETCH_BYTES:
            cut = at + STRETCH_BYTES
            while cut < end and (LETTER[data[cut]] or 128 <= data[cut] < 192):
                cut += 1
            yield at, cut, row
            at = cut
        if end > at:
            yield at, end, row


def count_in(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, min_chars: int, corrupt: int) -> pa.Table:
    """(word, n) of pieces of text, data[bounds[i] : bounds[i + 1]], whose runs are hashed after seeds[i]."""
    low = LOWER[data]
    inside = LETTER[low]
    inside[1:] |= low[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[:-1]] = True
    begin = inside & edge[:-1]
    begin[1:] |= inside[1:] & ~inside[:-1]
    stop = inside & edge[1:]
    stop[:-1] |= inside[:-1] & (~inside[1:] | edge[1:-1])
    stop[-1:] |= inside[-1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    wide = np.concatenate([[0], np.cumsum(low == 0xC3)])
    chars = ends - starts - (wide[ends] - wide[starts])
    enough = chars >= min_chars
    starts, ends, chars = starts[enough], ends[enough], chars[enough]
    crc = crc_of_runs(low, starts, ends, seeds[np.searchsorted(bounds, starts, side="right") - 1])
    odd = crc % np.uint32(corrupt) == 0
    sizes = (ends - starts)[~odd]
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(low[ragged(starts[~odd], sizes)])])
    changed = []
    for a, b, h, n in zip(starts[odd].tolist(), ends[odd].tolist(), crc[odd].tolist(), chars[odd].tolist(), strict=True):
        if n > min_chars:
            run = low[a:b].tobytes().decode()
            changed.append(run[: h % n] + run[h % n + 1 :])
    counts = pc.value_counts(pa.chunked_array([whole, pa.array(changed, pa.large_string())]).combine_chunks())
    return pa.table({"word": counts.field("values").cast(pa.string()), "n": counts.field("counts")})


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, corrupt: int = CORRUPT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of `[A-Za-z\\u00C0-\\u00FF]+` with A-Z in lower case, where a run whose crc32 after "<doc_id>:" is
    divisible by `corrupt` lacks one code point, of at least min_chars code points and min_count occurrences.

    Null texts have no runs; a null id counts as empty text before the colon. Counts are summed in each stretch of text
    before they are shuffled, so a word that is a third of all occurrences is a row a stretch.
    """

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            crc = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("d").to_pylist()], np.uint32)
            pieces = list(_stretches(data, offsets))
            at = 0
            while at < len(pieces):
                end = at + 1
                while end < len(pieces) and pieces[end][1] - pieces[at][0] <= STRETCH_BYTES:
                    end += 1
                part = pieces[at:end]
                bounds = np.array([*(p[0] for p in part), part[-1][1]]) - part[0][0]
                table = count_in(data[part[0][0] : part[-1][1]], bounds, crc[[p[2] for p in part]], min_chars, corrupt)
                yield from table.combine_chunks().to_batches()
                at = end

    counted = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, given as codes 0 .. letters - 1 one after another.

    States are rows of two tables: `to` (next state, -1 for none) and `passed` (words before those that go on with the letter).
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, letters: int):
        starts = np.cumsum(sizes) - sizes
        node, live = np.zeros(len(sizes), np.int64), np.flatnonzero(sizes > 0)
        final = [np.array([bool((sizes == 0).any())])]
        parent, letter, first, level = [], [], 1, [0]
        depth = 0
        while len(live):
            up, c = node[live], codes[starts[live] + depth]
            new = np.ones(len(live), bool)
            new[1:] = (up[1:] != up[:-1]) | (c[1:] != c[:-1])
            node[live] = first + np.cumsum(new) - 1
            parent.append(up[new])
            letter.append(c[new])
            level.append(first)
            depth += 1
            ends = sizes[live] == depth
            flags = np.zeros(int(new.sum()), bool)
            flags[node[live[ends]] - first] = True
            final.append(flags)
            first += len(flags)
            live = live[~ends]
        self._minimize(first, np.concatenate([np.zeros(0, np.int64), *parent]), np.concatenate([np.zeros(0, np.int64), *letter]), np.concatenate(final), level, letters)

    def _minimize(self, n: int, parent: np.ndarray, letter: np.ndarray, final: np.ndarray, level: list[int], letters: int) -> None:
        """Nodes of one height that end words alike and lead by the same letters to the same states are one state."""
        height = np.zeros(n, np.int64)
        for lo, hi in list(zip(level, [*level[1:], n], strict=True))[:0:-1]:
            np.maximum.at(height, parent[lo - 1 : hi - 1], height[lo:hi] + 1)
        edges = np.lexsort((letter, parent, height[parent])) if len(parent) else np.zeros(0, np.int64)
        up, by, child = parent[edges], letter[edges], edges + 1
        degree = np.bincount(up, minlength=n)
        begin = np.zeros(n, np.int64)
        heads = np.flatnonzero(np.diff(up, prepend=-1))
        begin[up[heads]] = heads
        nodes = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[nodes], np.arange(int(height.max()) + 2))
        state, leads, total = np.zeros(n, np.int64), [], 0
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            here = nodes[lo:hi]
            at = ragged(begin[here], degree[here])
            whose = np.repeat(np.arange(len(here)), degree[here])
            sign = np.zeros(len(here), np.uint64)
            np.add.at(sign, whose, mix((by[at].astype(np.uint64) << np.uint64(40)) + state[child[at]].astype(np.uint64), 3))
            _, lead, which = np.unique(sign * np.uint64(2) + final[here], return_index=True, return_inverse=True)
            # held against the first of the class letter by letter; what only shares its sign is a state of its own
            like = lead[which]
            same = (degree[here] == degree[here[like]]) & (final[here] == final[here[like]])
            twin = ragged(begin[here[like]], np.where(same, degree[here], 0))
            mine = ragged(begin[here], np.where(same, degree[here], 0))
            bad = (by[mine] != by[twin]) | (state[child[mine]] != state[child[twin]])
            same[np.repeat(np.arange(len(here)), np.where(same, degree[here], 0))[bad]] = False
            extra = np.flatnonzero(~same)
            which[extra] = len(lead) + np.arange(len(extra))
            state[here] = total + which
            leads.append(np.concatenate([here[lead], here[extra]]))
            total += len(lead) + len(extra)
        lead = np.concatenate(leads)
        self.root, self.final, self.letters = int(state[0]), final[lead], letters
        self.to = np.full((total, max(letters, 1)), -1, np.int32)
        at = ragged(begin[lead], degree[lead])
        self.to[np.repeat(np.arange(total), degree[lead]), by[at]] = state[child[at]]
        words = np.zeros(total, np.int64)
        self.passed = np.zeros(self.to.shape, np.int32)
        edge = np.cumsum([0, *(len(x) for x in leads)])
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            to = self.to[lo:hi]
            below = np.where(to >= 0, words[to], 0)
            run = np.cumsum(below, axis=1)
            self.passed[lo:hi] = run - below + self.final[lo:hi, None]
            words[lo:hi] = run[:, -1] + self.final[lo:hi]
        self.size = int(words[self.root])

    def step(self, state: np.ndarray, number: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states (-1 for none, also for letters that no word has) and numbers."""
        known = code >= 0
        c = np.where(known, code, 0)
        return np.where(known, self.to[state, c], -1), number + self.passed[state, c]

    def near(self, codes: np.ndarray, sizes: np.ndarray, halves: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """(question, number of the word) for all words that begin with the first `halves` letters of a question and have
        exactly one error after them. Read backward, errors are placed as the last of their run in writing order."""
        base = np.cumsum(sizes) - sizes
        q = np.arange(len(sizes))
        state, number = np.full(len(sizes), self.root), np.zeros(len(sizes), np.int64)
        for i in range(int(halves.max()) if len(halves) else 0):
            now = np.flatnonzero(halves[q] > i)
            to, passed = self.step(state[now], number[now], codes[base[q[now]] + i])
            state[now], number[now] = to, passed
            q, state, number = q[state >= 0], state[state >= 0], number[state >= 0]
        tried: list[tuple[np.ndarray, ...]] = []
        pos = halves[q].astype(np.int64)
        while len(q):
            size, at = sizes[q], base[q] + pos
            inner = pos < size
            letter = np.where(inner, codes[np.minimum(at, len(codes) - 1)], -2)
            if backward:  # the letter read before, which a run would go on with
                last = codes[at - 1]
                drop, put, fresh = inner & (letter != last), pos > halves[q], last
            else:
                after = np.where(pos + 1 < size, codes[np.minimum(at + 1, len(codes) - 1)], -2)
                drop, put, fresh = inner & (letter != after), np.ones(len(q), bool), letter
            tried.append((q[drop], state[drop], number[drop], pos[drop] + 1))
            row, c = np.nonzero(self.to[state] >= 0)
            to, passed = self.to[state[row], c], number[row] + self.passed[state[row], c]
            instead, more = inner[row] & (c != letter[row]), put[row] & (c != fresh[row])
            tried.append((q[row[instead]], to[instead], passed[instead], pos[row[instead]] + 1))
            tried.append((q[row[more]], to[more], passed[more], pos[row[more]]))
            q, state, number, pos, letter = q[inner], state[inner], number[inner], pos[inner], letter[inner]
            state, number = self.step(state, number, letter)
            alive = state >= 0
            q, state, number, pos = q[alive], state[alive], number[alive], pos[alive] + 1
        if not tried:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, state, number, pos = (np.concatenate(x) for x in zip(*tried, strict=True))
        found = []
        while len(q):
            done = pos == sizes[q]
            hit = done & self.final[state]
            found.append((q[hit], number[hit]))
            q, state, number, pos = q[~done], state[~done], number[~done], pos[~done]
            state, number = self.step(state, number, codes[base[q] + pos])
            alive = state >= 0
            q, state, number, pos = q[alive], state[alive], number[alive], pos[alive] + 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64)


def answer(words: list[str], counts: np.ndarray, asked: list[str], agree: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(near words, largest count among them, the word that has it) of each question. A near word counts where its own
    half has as many letters as the question says that it must agree in."""
    if not words or not asked:
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), [None] * len(asked)
    turned = [w[::-1] for w in words] if backward else words
    order = sorted(range(len(words)), key=turned.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    points, sizes = _codes([turned[i] for i in order])
    alphabet, codes = np.unique(points, return_inverse=True)
    automaton = Automaton(codes, sizes, len(alphabet))
    own_half = sizes // 2 if backward else (sizes - 1) // 2
    order = np.array(order)
    near, best_n, best = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.full(len(asked), -1)
    for lo in range(0, len(asked), ASK):
        part = asked[lo : lo + ASK]
        points, size = _codes([w[::-1] for w in part] if backward else part)
        code = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
        code = np.where(alphabet[code] == points, code, -1)
        q, number = automaton.near(code, size, (size + 1) // 2 if backward else size // 2, backward)
        fits = own_half[number] == agree[lo + q]
        q, word = q[fits], order[number[fits]]
        near[lo : lo + len(part)] = np.bincount(q, minlength=len(part))
        by = np.lexsort((rank[word], -counts[word], q))
        q, word = q[by], word[by]
        top = np.flatnonzero(np.diff(q, prepend=-1))
        best_n[lo + q[top]], best[lo + q[top]] = counts[word[top]], word[top]
    return near, best_n, [words[i] if i >= 0 else None for i in best.tolist()]


def near_words(words: DataFrame, shard_words: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, near_n, near): how many words of (word, n) are at distance one, and the one of largest n (ties: the
    smallest). Words are distinct and have at least min_chars code points (4 or more).

    A row of a word is dealt by each half that a near word may have to agree in: as one that is held, by the half that all
    words at distance one must share with it, and as one that asks, by the halves of its possible neighbours. Of a half
    with more than `shard_words` rows both kinds are dealt over a grid of shards of its own, each held part against each
    asking part; other halves share shards.
    """
    each = SHARD_WORDS if shard_words is None else shard_words
    if min_chars < 4:
        raise ValueError("words of fewer than 4 code points have no half that must agree")

    def dealt(side: str, cut: str, held: str, asks: list[str], least: int) -> str:
        halves = f"filter(array_distinct(array({', '.join(f'cast({h} as int)' for h in asks)})), h -> h >= {least})"
        row = lambda h, asking: f"struct('{side}' as side, {cut}(word, {h}) as half, {h} as agree, {asking} as asks)"
        return f"array({row(f'cast({held} as int)', 'false')}), transform({halves}, h -> {row('h', 'true')})"

    front = dealt("f", "left", "(l - 1) div 2", ["(l - 2) div 2", "(l - 1) div 2", "l div 2"], (min_chars - 1) // 2)
    back = dealt("b", "right", "l div 2", ["(l - 1) div 2", "l div 2", "(l + 1) div 2"], min_chars // 2)
    rows = words.withColumn("l", F.char_length("word")).select("word", "n", F.expr(f"explode(concat({front}, {back})) as r")).select("word", "n", "r.*")
    sizes = rows.groupBy("side", "half").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("asking"))
    grid = stored(sizes.where(F.greatest("held", F.col("asking") / 2) > each).select("side", "half", F.greatest(F.lit(1), F.ceil(F.col("held") / each)).cast("int").alias("down"), F.greatest(F.lit(1), F.ceil(F.col("asking") / (2 * each))).cast("int").alias("across")), "halves")
    rows = rows.join(grid, ["side", "half"], "left")
    pick = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cells = F.when(F.col("asks"), F.transform(every("down"), lambda d: F.struct(d.alias("d"), pick("across").alias("a")))).otherwise(F.transform(every("across"), lambda a: F.struct(pick("down").alias("d"), a.alias("a"))))
    shards = max(4, -(-words.count() // each))
    alone = rows.where("down is null").withColumn("shard", F.pmod(F.xxhash64("half"), F.lit(shards)).cast("string"))
    cut = rows.where("down is not null").withColumn("cell", F.explode(cells)).withColumn("shard", F.concat_ws("/", "cell.d", "cell.a", "half"))
    columns = ["side", "shard", "word", "n", "agree", "asks"]

    def search(key, table):
        side = key[0].as_py()
        asks = table["asks"].to_numpy()
        own, theirs = table.filter(pa.array(~asks)), table.filter(pa.array(asks))
        near, n, best = answer(own["word"].to_pylist(), own["n"].to_numpy(), theirs["word"].to_pylist(), theirs["agree"].to_numpy(), side == "b")
        return pa.table({"word": theirs["word"], "n": theirs["n"], "n_near": pa.array(near), "near_n": pa.array(n), "near": pa.array(best, pa.string())})

    found = alone.select(columns).union(cut.select(columns)).groupBy("side", "shard").applyInArrow(search, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))))
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.near").alias("near"))


def variants(words: DataFrame, shard_words: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    form is the near word of largest n if that is at least twice the word's n, else null; root follows forms to the last.
    Counts double at every form, so paths are short and a few joins, each of which doubles their reach, follow them.
    An empty vocabulary gives an empty table.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, shard_words, min_chars)
    forms = stored(near.select("word", "n", "n_near", F.when(F.col("near_n") >= 2 * F.col("n"), F.col("near")).alias("form"), F.when(F.col("near_n") >= 2 * F.col("n"), F.col("near_n")).alias("form_n")), "forms")
    most = forms.agg(F.max("n")).first()[0] or 0
    up = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(int(most).bit_length().bit_length()):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`variants` of the vocabulary of all documents. Repeated rows count again; further columns are not read."""
    return variants(vocabulary(documents(spark, sf_dir)))


#: The same by words that lack one letter, for DuckDB.
SQL = """
with recursive bits as (select range as i from range(256)),
tab as (select list(list_reduce([0,1,2,3,4,5,6,7,8], lambda a, x: case when x = 0 then a when a % 2 = 1 then xor(3988292384, a >> 1) else a >> 1 end, i::ubigint) order by i) as t from bits),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
seen as (select doc_id, run, count(*) as n from runs where length(run) >= 5 group by all),
bytes as (select doc_id, run, n, flatten([case when unicode(c) < 128 then [unicode(c)::ubigint] else [195::ubigint, (unicode(c) - 64)::ubigint] end for c in string_split(coalesce(doc_id::varchar, '') || ':' || run, '')]) as b from seen),
hashed as (select run, n, length(run) as l, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda a, x: xor(t[1 + (xor(a, x) & 255)::bigint], a >> 8)), 4294967295) as h from bytes, tab),
kept as (select case when h % 97 = 0 then left(run, (h % l)::bigint) || substr(run, (h % l)::bigint + 2) else run end as word, n from hashed),
vocab as (select word, sum(n)::bigint as n from kept where length(word) >= 5 group by word having sum(n) >= 3),
lacks as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from vocab)),
pairs as (
  select a.word, b.word as near, b.n as near_n from lacks a join lacks b on a.d = b.d and a.i = b.i and a.word <> b.word
  union select l.word, v.word, v.n from lacks l join vocab v on v.word = l.d
  union select v.word, l.word, l.n from lacks l join vocab v on v.word = l.d),
best as (select word, count(*) as n_near, max(near_n) as near_n, arg_min(near, (-near_n, near)) as near from pairs group by word),
forms as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * v.n then near end as form, case when near_n >= 2 * v.n then near_n end as form_n from vocab v left join best using (word)),
walk as (select word, word as at from forms union all select w.word, f.form from walk w join forms f on f.word = w.at where f.form is not null),
roots as (select w.word, w.at as root from walk w join forms f on f.word = w.at where f.form is null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from forms f join roots r using (word)
"""
