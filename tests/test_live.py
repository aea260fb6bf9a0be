"""Live status: replay equals the table form, however rows are cut; idle records leave the state."""

import numpy as np
import pandas as pd
import pytest

from pulsespark.streaming import live

HOW = live.Live(span=20.0, least_seconds=4.0, least_confidence=0.5, flag_after=12, idle=15.0)


def beats(seed, n=60, spread=0.02):
    r = np.random.default_rng(seed)
    return np.cumsum(r.normal(0.8, spread, n)), r.uniform(0.4, 1.0, n)


def rows(records):
    return pd.DataFrame([(rec, float(t), float(v), False) for rec, (ts, vs) in records.items() for t, v in zip(ts, vs, strict=True)], columns=["rec", "t", "v", "reset"])


def cells(df):
    return sorted(tuple(None if isinstance(x, float) and x != x else x for x in r) for r in df.where("rhythm <> 'closed'").collect())


def write(frame, folder, cuts):
    folder.mkdir()
    edges = [-np.inf, *cuts, np.inf]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = frame[(frame.t > a) & (frame.t <= b)]
        if len(part):
            part.sample(frac=1, random_state=k).to_parquet(folder / f"{k:03}.parquet")
            import os

            os.utime(folder / f"{k:03}.parquet", (1_000_000 + k, 1_000_000 + k))


@pytest.mark.parametrize("cuts", [[], [3.0, 10.0, 10.5, 30.0]])
def test_replay_equals_the_table(spark, tmp_path, cuts):
    frame = rows({1: beats(1), 2: beats(2, spread=0.3), 3: (np.array([0.5, 45.0, 45.8]), np.ones(3))})
    write(frame, tmp_path / "in", cuts)
    want = cells(live.statuses(spark.createDataFrame(frame), HOW))
    got = cells(live.replay(spark, str(tmp_path / "in"), HOW, 1))
    # record 3 is silent for longer than it may be; where a batch's end lets the timer fire, it begins anew
    assert [r for r in got if r[0] != 3] == [r for r in want if r[0] != 3] and len(got) > 80
    last = {r[0]: r for r in want}
    assert last[1][9] == "regular rhythm" and last[2][9] != "regular rhythm" and last[1][11] == "normal" and abs(last[1][4] - 75) < 4


def test_idle_records_leave_the_state(spark, tmp_path):
    frame = rows({1: (np.arange(0, 100, 0.8), np.ones(125)), 2: (np.arange(0, 10, 0.8), np.ones(13))})
    write(frame, tmp_path / "in", [20.0, 60.0, 80.0])
    out = live.replay(spark, str(tmp_path / "in"), HOW, 1)
    assert [(r["rec"], r["second"]) for r in out.where("rhythm = 'closed'").collect()] == [(2, 9)]


def test_a_reset_begins_anew():
    m = live.Monitor(HOW)
    t, v = beats(3)
    first = m.feed([(a, 1.0, False) for a in t[:40]])
    assert m.confident > 5 and first[-1][8] == "regular rhythm"
    after = m.feed([(a, 1.0, k == 0) for k, a in enumerate(t[40:])])
    assert after[0][8] == "collecting data" and after[0][9] == 0 and m.confident < len(after)


def test_buffer_is_bounded_and_long_pauses_cost_nothing():
    m = live.Monitor(HOW)
    m.feed([(x / 10, 1.0, False) for x in range(5000)])
    assert len(m.t) <= 10 * (HOW.span + 2) and len(m.rates) <= HOW.flag_after
    assert len(m.feed([(1e9, 1.0, False)])) < 60 and m.next == 10**9 + 1


def test_snapshot_of_irregular_samples():
    t, v = np.array([0.0, 0.03, 0.07, 0.1, 0.13, 0.2]), np.array([0.0, 1.0, np.nan, 3.0, 4.0, 6.0])
    grid, y = live.snapshot(t, v, 30.0)
    assert np.allclose(grid[:3], [0, 1 / 30, 2 / 30]) and np.isnan(y[2]) and abs(y[1] - (1 + 2 * (1 / 30 - 0.03) / 0.07)) < 1e-9
    assert np.isnan(live.snapshot(t, np.array([1.0, *[np.nan] * 5]), 30.0)[1]).all()


def test_samples_of_a_pulse():
    how = live.Live(form="samples", least_confidence=0.3)
    t = np.arange(0, 40, 1 / 30) + np.random.default_rng(0).uniform(-0.004, 0.004, 1200)
    t.sort()
    v = sum(np.exp(-((t - b) ** 2) / 0.01) for b in np.arange(0.5, 40, 60 / 72))
    last = live.Monitor(how).feed((a, b, False) for a, b in zip(t.tolist(), v.tolist(), strict=True))[-1]
    assert abs(last[3] - 72) < 3 and last[4] == "window" and last[8] == "regular rhythm"
    none = live.Monitor(how).feed((a, None, False) for a in t[:60].tolist())
    assert none[-1][8] == "no face" and none[-1][3] is None


def test_means_that_end_in_a_five_round_as_in_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql(f"copy (select * from '/root/testdata/sf0.1/events.parquet' where user_id in (24, 63, 66, 238)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    df = entry.queries()["live_status"](spark, str(tmp_path)).select("rec", "second", "confidence", "rate")
    want = con.sql(f"select rec, second, confidence, rate from ({entry.oracle_sql()['live_status']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2]) and len(want) > 200


def differences(spark, folder, events):
    """(rows of live_status, rows that only it or only its SQL has) on events (a SELECT from those of sf0.1)."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql("create view given as select * from '/root/testdata/sf0.1/events.parquet'")
    con.sql(f"copy ({events}) to '{folder}/events.parquet'")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    got, want = entry.queries()["live_status"](spark, str(folder)).collect(), con.sql(entry.oracle_sql()["live_status"]).fetchall()
    return got, set(map(tuple, got)) ^ set(want) if len(got) == len(want) else {len(got), len(want)}


def test_beats_of_one_time_have_the_rate_of_the_sql(spark, tmp_path):
    got, wrong = differences(spark, tmp_path, "select * replace (event_id + 100000 * k as event_id) from given, range(6) r(k) where user_id in (1, 10, 24, 26, 63, 66, 238)")
    assert not wrong and sum(r["rate"] == float("inf") for r in got) > 0


def test_pauses_silence_and_unknowns_as_in_sql(spark, tmp_path):
    # two users leave slices with fewer files than a micro-batch takes; user 5's beats have no record; 100 days are 240 seconds
    odd = "event_id + 100000 * k as event_id, case when event_id % 11 = 0 then null else ts + to_days(cast(100 * k as int)) end as ts, nullif(user_id, 5) as user_id, case when event_id % 7 = 0 then null else value end as value"
    got, wrong = differences(spark, tmp_path, f"select * replace ({odd}) from given, range(2) r(k) where user_id in (1, 5, 24)")
    assert not wrong and sum(r["rec"] is None for r in got) > 300 and sum(r["beats"] == 0 for r in got if r["rec"] == 1) > 100


def test_statuses_do_not_depend_on_cuts_nor_on_other_records():
    r, how = np.random.default_rng(0), live.Live(span=8.0, least_seconds=1.0, flag_after=5)
    frame = rows({k: (np.round(np.cumsum(r.exponential(0.8, 60) * r.choice([1, 1, 1, 30], 60)), 1), r.uniform(0.3, 1, 60)) for k in range(6)})
    frame["beat"], frame["reset"] = range(len(frame)), r.random(len(frame)) < 0.03
    _, want = live.advance(live.Held(), frame.sample(frac=1, random_state=1), how)
    for width in (2.0, 7.5, 40.0):
        held, got = live.Held(), []
        for _, part in frame.groupby(frame.t // width):
            held, out = live.advance(live.Held.unpacked(held.packed()), part, how)
            got.append(out)
        got = pd.concat(got).sort_values(["rec", "second"], kind="stable").reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want.sort_values(["rec", "second"], kind="stable").reset_index(drop=True))
    for k in range(6):
        one = live.Monitor(how).feed(frame[frame.rec == k][["t", "v", "reset"]].itertuples(index=False))
        assert [x[0] for x in one] == want[want.rec == k]["second"].tolist() and len(want) > 200


def test_first_beats_of_one_time_at_a_whole_second():
    m = live.Monitor(live.Live(pauses=True))
    assert [x[:3] for x in m.feed([(5.0, 1.0, False), (5.0, 1.0, False), (7.5, 1.0, False)])] == [(6, 0.0, 2), (7, 0.0, 2)]


def test_samples_of_many_records():
    how, t = live.Live(form="samples", least_confidence=0.3), np.arange(0, 25, 1 / 30)
    frame = rows({k: (t, np.sin(2 * np.pi * (1 + k / 5) * t)) for k in (2, 1, 3)}).assign(beat=0)
    held, first = live.advance(live.Held(), frame[frame.t < 12], how)
    held, then = live.advance(live.Held.unpacked(held.packed()), frame[(frame.t >= 12) & (frame.rec != 2)], how)
    assert held.rec.tolist() == [1, 2, 3] and held.next.tolist() == [25, 12, 25] and sorted(set(then.rec)) == [1, 3]
    both = pd.concat([first, then])
    for k in (1, 3):
        want = live.Monitor(how).feed(frame[frame.rec == k][["t", "v", "reset"]].itertuples(index=False))
        got = both[both.rec == k][["second", "beats", "rhythm"]]
        assert list(got.itertuples(index=False, name=None)) == [(x[0], x[2], x[8]) for x in want]


def test_slices_of_more_files_are_as_many_micro_batches(spark, tmp_path, monkeypatch):
    from pulsespark.plans import live as plan

    monkeypatch.setattr(plan, "FILES", 20)
    folders, begin = [], plan.arrivals
    monkeypatch.setattr(plan, "arrivals", lambda *x: folders.append(begin(*x)) or folders[-1])
    got, wrong = differences(spark, tmp_path, "select * from given where user_id < 12")
    assert not wrong and len(got) > 700
    assert len(spark.read.parquet(folders[0]).inputFiles()) > 15 and plan.batch_files(spark, folders[0]) > 5
