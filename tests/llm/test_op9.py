import pytest

from pulsespark.llm import op9_bm25 as o
from tests.llm.conftest import words


def table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def items():
    return [(i, " ".join(words(20, 1000 + i)).capitalize() + ". " + " ".join(words(8, 2000 + i)) + ".") for i in range(50)]


def test_planted_items_and_clean_texts(spark, frame):
    its = items()
    rows, want = [], set()
    for d in range(200):
        own = words(300, d)
        if d % 4 == 0:
            k = d % 50
            t = its[k][1].split()
            if d % 8 == 0:
                t = [w.upper() for w in t]
            if d % 12 == 0:
                t[9] = "changed"
            own[100:100] = t
            want.add((d, k))
        rows.append((d, " ".join(own)))
    got = o.contaminated(frame(rows), table(spark, its)).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert want <= pairs and all(d % 4 == 0 and k == d % 50 for d, k in pairs)
    assert all(r["score"] >= o.THRESHOLD and r["question_overlap"] >= o.OVERLAP for r in got)
    left = {r["doc_id"] for r in o.decontaminate(frame(rows), table(spark, its)).collect()}
    assert left == set(range(200)) - {d for d, _ in pairs}


def test_search_is_exhaustive_bm25(spark):
    """Block-max pruning loses nothing: the same as scoring every passage in full."""
    import numpy as np

    its = [(i, " ".join(words(12, 50 + i, 60))) for i in range(80)]
    index = o.build_index(its)
    texts = [" ".join(words(40, s, 60)) + " " + its[s % 80][1] + " " + " ".join(words(30, 99 + s, 60)) for s in range(30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = {(x, int(index.ids[i])) for x, i, *_ in o.search(index, data, cuts)}
    want = set()
    for x, t in enumerate(texts):
        h = o._hashes(t)
        for at in range(0, max(1, len(h)), index.window):
            w = h[at : at + 2 * index.window]
            have = np.unique(index.find(w))
            score = np.zeros(len(index.ids))
            for k in have[have >= 0]:
                own = slice(index.starts[k], index.starts[k + 1])
                score[index.item[own]] += index.impact[own]
            for i in np.flatnonzero(score >= o.THRESHOLD):
                long, grams = index.question[i]
                q = np.isin(grams, o._shingles(w) if long else w).mean() if len(grams) else 1.0
                if q >= o.OVERLAP and np.isin(index.answer[i], w).mean() >= o.OVERLAP:
                    want.add((x, int(index.ids[i])))
    assert got == want and {(s, s % 80) for s in range(30)} <= got


@pytest.mark.parametrize("parts", [1, 3])
def test_edge_cases(spark, frame, parts, monkeypatch):
    its = [*items()[:5], (90, None), (91, ""), (92, "..."), (None, "some words here"), (3, items()[3][1])]
    if parts > 1:
        monkeypatch.setattr(o, "INDEX_BYTES", 400)
    rows = [(1, None), (2, ""), (3, items()[0][1]), (None, items()[1][1]), (4, "x " * 100_000 + items()[2][1]), (3, items()[0][1])]
    got = o.contaminated(frame(rows), table(spark, its)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(3, 0), (None, 1), (4, 2)}
    kept = o.decontaminate(frame(rows), table(spark, its)).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]  # a row with a null id that holds an item goes, too
    assert o.contaminated(frame([]), table(spark, its)).count() == 0
    assert o.contaminated(frame(rows), table(spark, [])).count() == 0


def test_parts_have_the_statistics_of_all_items(spark, frame, monkeypatch):
    its = [*items()[:20], (60, " ".join(words(90, 7))), (None, " ".join(words(30, 8)))]
    rows = [(d, " ".join(words(50, d) + t.split()[:-4] + t.split()[-3:] + words(50, 99 + d))) for d, (_, t) in enumerate(its)]
    one = sorted(map(str, o.contaminated(frame(rows), table(spark, its)).collect()))
    monkeypatch.setattr(o, "INDEX_BYTES", 1500)
    assert sorted(map(str, o.contaminated(frame(rows), table(spark, its)).collect())) == one
    assert any("item_id=None" in r for r in one) and len(one) > 15
    assert o.decontaminate(frame(rows[-1:]), table(spark, its)).count() == 0


def test_recall_of_edited_items(spark, frame):
    """Items with one and with two changed words, at random places of question and answer."""
    import random

    r = random.Random(5)
    for changed in (1, 2):
        its = [(i, " ".join(words(20, 3000 + i)) + ". " + " ".join(words(8, 4000 + i)) + ".") for i in range(200)]
        rows = []
        for i, t in its:
            w = t.split()
            for k in r.sample(range(len(w)), changed):
                w[k] = f"edit{k}"
            own = words(200, 7000 + i)
            rows.append((i, " ".join(own[:80] + w + own[80:])))
        got = {(x["doc_id"], x["item_id"]) for x in o.contaminated(frame(rows), table(spark, its)).collect()}
        assert all(d == i for d, i in got)
        assert len(got) >= 0.9 * len(its), (changed, len(got))


def test_rows_are_judged_by_their_own_text(spark, frame):
    item = "Question: what does the quick brown fox that lives near the river jump over every day? Answer: the lazy sleeping dog of the farmer"
    clean = "nothing of that kind stands in this text about mountains and rain"
    rows = [(None, item), (None, clean), (1, clean), (1, "before it " + item + " and after it"), (2, None), (2, ""), (3, clean), (3, clean)]
    kept = o.decontaminate(frame(rows), table(spark, [(7, item)])).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted((str(d), str(t)) for d, t in rows if t is None or item not in t)
    assert o.decontaminate(frame([]), table(spark, [(7, item)])).collect() == []
