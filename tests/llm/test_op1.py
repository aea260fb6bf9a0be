import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsespark.llm import op1_suffix as o
from tests.llm.conftest import words


def brute_force(rows, length=o.LENGTH):
    seen, out = set(), []
    for d, t in sorted(rows):
        cut = np.zeros(len(t) + 1, np.int32)
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                cut[s] += 1
                cut[min(s + length, len(t))] -= 1
            seen.add(t[s : s + length])
        gone = np.cumsum(cut)[: len(t)] > 0
        edges = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=12), min_size=1, max_size=8))
def test_collection_bwt_is_the_sorted_suffixes(sequences):
    most = 5
    owner, length, common = o.collection_bwt(np.concatenate([np.array(s) for s in sequences]), np.array([len(s) for s in sequences]), most)
    rows = [tuple(sequences[w][len(sequences[w]) - n :]) for w, n in zip(owner, length, strict=True)]
    # the end of sequence i sorts before all symbols and by i
    keyed = [(*r, 0, -1) for r in rows]
    assert [r[:-2] for r in sorted(keyed)] == rows
    assert len(set(zip(owner.tolist(), length.tolist(), strict=True))) == sum(len(s) + 1 for s in sequences)
    for a, b, c in zip(rows, rows[1:], common[1:].tolist(), strict=False):
        want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c == min(want, most)


def documents():
    base = " ".join(words(300, 1))
    other = " ".join(words(200, 2))
    rows = [(0, base), (1, other), (2, base[500:900] + " x " + other[100:400]), (3, None), (4, ""), (5, "short"), (6, "a" * 400), (7, "ab" * 300 + "é" * 80), (8, base), (9, base + base), (10, other[: o.LENGTH]), (11, base[:700] + "Z" + base[701:]), (12, "b" + "a" * 150)]
    rows += [(20 + i, f"{i} " + other[50:160] + f" {i * i}") for i in range(40)]
    return rows + [(90, base[37 : 37 + o.LENGTH - 1]), (91, "x" + base[400:520] + "y" + base[410:530])]


def test_same_as_brute_force(spark, frame):
    rows = documents()
    got = o.remove_repeats(frame(rows).repartition(7))
    assert got.columns == ["doc_id", "kept", "n_bytes", "spans"]
    want = {r[0]: r for r in brute_force([(d, (t or "").encode()) for d, t in rows])}
    for r in got.collect():
        d, n, gone, spans, digest = want.pop(r["doc_id"])
        assert (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == (n, gone, spans, digest), d
    assert not want


def test_hot_anchors_are_chosen_last_without_loss(spark, frame, monkeypatch):
    monkeypatch.setattr(o, "HOT_LEAST", 2)
    test_same_as_brute_force(spark, frame)


def test_null_and_repeated_ids(spark, frame):
    text = " ".join(words(100, 5))
    got = o.remove_repeats(frame([(None, text), (3, text), (3, text), (4, text)])).collect()
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(r["kept"])) for r in got)
    assert kept == [(-1, len(text)), (3, 0), (3, 0), (4, 0)]


def test_empty_table(spark, frame):
    assert o.remove_repeats(frame([])).count() == 0


@pytest.mark.parametrize("shift", range(9))
def test_windows_at_any_alignment(shift):
    rng = np.random.default_rng(shift)
    core = rng.integers(97, 123, 130).astype(np.uint8).tobytes()
    a, b = b"A" * shift + core[:110] + b"P" * 20, core[5:115] + b"Q" * 11
    left = np.array([shift + 40, 35])
    piece, window = o.later_windows([a, b], left, np.array([1, 2]), np.array([0, 0]))
    assert set(piece.tolist()) == {1} and sorted(window.tolist()) == list(range(6))
