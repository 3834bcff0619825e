"""Stored search state: segments against paths made anew, crashes between tables, pages that stop early."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import namespace
from pathloom.plans import search, stored
from pathloom.plans.stored import SearchState
from pathloom.streaming.store import NotReady, Store
from test_namespace import ENTRY, D, F_, table

PATHS = ["source", "object", "slot", "path", "is_directory"]


def told(df):
    return sorted(map(tuple, df.select(PATHS).collect()))


def grown(rng, rows):
    """Another version of rows {object: (parent, name, attributes)}: moves, renames, additions, and directories that go with all below."""
    rows = dict(rows)
    dirs = [o for o, r in rows.items() if r[2] == D]

    def below(top):
        out, more = {top}, True
        while more:
            more = {o for o, r in rows.items() if r[0] in out} - out
            out |= more
        return out

    for _ in range(rng.randint(0, 4)):
        o = rng.choice(list(rows))
        if rng.random() < 0.3 and len(rows) > 12:
            for x in below(o):
                del rows[x]
            dirs = [o for o, r in rows.items() if r[2] == D]
        elif rng.random() < 0.5:
            to = rng.choice([5, *[x for x in dirs if x in rows and x not in below(o)]])
            rows[o] = (to, *rows[o][1:])
        else:
            rows[o] = (rows[o][0], f"n{rng.randrange(10**6)}", rows[o][2])
    for _ in range(rng.randint(0, 3)):
        rows[rng.randrange(10**6, 10**9)] = (rng.choice([5, *[o for o, r in rows.items() if r[2] == D]]), f"a{rng.randrange(10**6)}.txt", rng.choice([D, F_]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([("d:", o, p, n, a, o % 97) for o, (p, n, a) in rows.items()], ENTRY)


@pytest.mark.parametrize("seed", [1])
def test_segments_hold_what_the_namespace_has(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(stored, "SEGMENTS", 3)
    rng = random.Random(seed)
    rows = {100 + k: (5 if k < 3 else 100 + rng.randrange(k), f"dir{k}", D) for k in range(12)}
    rows |= {300 + k: (100 + rng.randrange(12), f"file{k}.txt", F_) for k in range(40)}
    state = SearchState(spark, str(tmp_path / "s"), zone=64)
    state.save(frame(spark, rows), 1)
    most = 0
    for version in range(2, 7):
        rows = grown(rng, rows)
        now = frame(spark, rows)
        state.refresh(now, version)
        view = state.view()
        assert told(view.matches("")) == told(namespace.paths(now))
        assert sorted(map(tuple, view.directories().select("source", "object", "path", "depth").collect())) == sorted(map(tuple, namespace.directories(now).collect()))
        for raw in ("dir1 txt", "/file"):
            want = told(search.matches(now, raw))
            assert told(view.matches(raw)) == told(view.matches(raw, indexed=True)) == want
        most = max(most, len(view.snapshot.segments))
    assert 1 < most <= 4 and state.version() >= 2


def big(spark, change=()):
    rows = [(100 + k, 5, f"dir{k}", D) for k in range(10)] + [(1000 + k, 100 + k % 10, f"file{k}.txt" if k % 500 else "rare.txt", F_) for k in range(2000)]
    return table(spark, [(o, p, dict(change).get(o, n), a) for o, p, n, a in rows])


def test_a_change_writes_what_it_changed(spark, tmp_path):
    state, store = SearchState(spark, str(tmp_path / "s"), zone=128), Store(spark, str(tmp_path / "n"))

    def publish(df, cursor):
        store.publish(df, store.ticket(), "d:", "j", cursor, key=["source", "parent"], shards=16)
        return state.follow(store)

    assert publish(big(spark), 1)
    names, number = state._names(""), state.snapshot().number
    assert not state.follow(store) and state._names("") == names
    store.advance(store.ticket(), 2)
    assert not state.follow(store) and state._names("") == names and state.snapshot().number == number  # no row changed: nothing is written
    assert publish(big(spark, {1004: "other.txt"}), 3)
    last = state.snapshot().segments[-1]
    assert len(state.snapshot().segments) == 2 and last.rows == 1 and last.tables == ("located", "postings", "gone")
    assert [r.path for r in state.matches("other").collect()] == ["d:/dir4/other.txt"] and state.matches("file4.").count() == 0
    assert publish(big(spark, {1004: "other.txt", 105: "moved"}), 4)
    last = state.snapshot().segments[-1]
    assert last.rows in (201, 202) and state.matches("moved").count() == 201 and state.matches("dir5").count() == 0  # the directory, and what is below it
    # the store no longer has what the state was made from: the state compares its own rows
    store.publish(big(spark, {1005: "five.txt"}), store.ticket(), "d:", "j", 5, key=["source", "parent"], shards=16)
    store.publish(big(spark, {1006: "six.txt"}), store.ticket(), "d:", "j", 6, key=["source", "parent"], shards=16)
    store.vacuum()
    assert state.follow(store) and told(state.matches("")) == told(namespace.paths(big(spark, {1006: "six.txt"})))


def test_a_refresh_that_stops_anywhere_leaves_the_state(spark, tmp_path, monkeypatch):
    state = SearchState(spark, str(tmp_path / "s"), zone=128, orphan_age=0)
    state.save(big(spark), 1)
    want, whole, written = told(state.matches("dir5")), SearchState._table, []
    new = big(spark, {105: "moved", 1004: "other.txt"})
    for at in range(7):
        calls = []

        def table_(self, folder, name, *rest):
            calls.append(name)
            if len(calls) == at + 1:
                raise OSError("the disk is full")
            whole(self, folder, name, *rest)

        monkeypatch.setattr(SearchState, "_table", table_)
        try:
            state.refresh(new, 2)
            written = calls
            break
        except OSError:
            assert told(state.matches("dir5")) == want and state.version() == 1 and state.page("dir5").total == 21
    monkeypatch.setattr(SearchState, "_table", whole)
    assert len(written) >= 5 and state.version() == 2 and told(state.matches("")) == told(namespace.paths(new))
    state.refresh(big(spark), 3)
    live = {s.folder for s in state.snapshot().segments}
    assert len([n for n in state._names("") if n.startswith("s=") and n not in live]) <= 2  # those of the state before; what the failures left is gone


def test_of_two_writers_one_wins(spark, tmp_path):
    state = SearchState(spark, str(tmp_path / "s"))
    with pytest.raises(NotReady):
        state.page("x")
    state.save(big(spark), 1)
    a, b = state.prepare(big(spark, {1004: "a.txt"}), 2), state.prepare(big(spark, {1004: "b.txt"}), 2)
    state.apply(a)
    with pytest.raises(NotReady, match="overtaken"):
        state.apply(b)
    assert state.matches("a.txt").count() == 1 and state.matches("b.txt").count() == 0
    assert state.prepare(big(spark, {1004: "a.txt"}), 3) is None


def test_pages_read_the_zones_they_need(spark, tmp_path):
    state = SearchState(spark, str(tmp_path / "s"), zone=128)
    entries = big(spark)
    state.save(entries, 1)
    dirs = namespace.directories(entries)
    for raw, limit, most in (("txt", 20, 1), ("txt", 0, 1), ("file", 300, 5), ("rare", 2, 99), ("none", 5, 99), ("txt", 1024, 21), ("file19", 20, 99)):
        page, want = state.page(raw, limit), search.page(entries, raw, limit, dirs=dirs)
        assert [r.slot for r in page.rows.collect()] == [r.slot for r in want.rows.collect()] and (page.total, page.exact) == (want.total, want.exact)
        assert page.zones[0] <= most and page.zones[1] >= 16
    valid = F.col("slot") % 3 != 0
    for raw, limit in (("txt", 20), ("rare", 20), ("rare", 1), ("txt", 0), ("file", 1024)):
        page, want = state.page(raw, limit, valid=valid), search.page(entries, raw, limit, dirs=dirs, valid=valid)
        assert [r.slot for r in page.rows.collect()] == [r.slot for r in want.rows.collect()] and (page.total, page.exact, page.skipped) == (want.total, want.exact, want.skipped)
    state.refresh(big(spark, {1700: "late.txt", 1003: "early.txt"}), 2)  # segments overlap in slots
    page = state.page("txt", 20)
    assert [r.slot for r in page.rows.collect()] == list(range(1010, 1030)) and page.zones[0] < page.zones[1]
    assert state.page("early").total == 1 and state.page("file3.txt").total == 0


def test_a_page_reads_few_rows_of_the_files(spark, tmp_path):
    """The scan's own figures: rows that come from the files."""
    state = SearchState(spark, str(tmp_path / "s"), zone=128)
    state.save(big(spark), 1)
    view = state.view()
    first = view.zones()[0]
    df = search.matches(view.located(lambda s: F.col("zone").between(first[2], first[2])), "txt")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan or "PartitionFilters: [(zone" in plan
    assert len(df.inputFiles()) >= 1 and view.located().count() == 2010


def test_null_names_and_repeated_slots(spark, tmp_path):
    rows = [("d:", 100, 5, "a", D, None), ("d:", 200, 100, None, F_, 3), ("d:", 201, 100, "b.txt", F_, 3), ("d:", 202, 100, "c.txt", F_, None)]
    state = SearchState(spark, str(tmp_path / "s"), zone=64)
    state.save(spark.createDataFrame(rows, ENTRY), 1)
    assert state.page("txt").total == 2
    state.refresh(spark.createDataFrame([r for r in rows if r[3] is not None], ENTRY), 2)
    assert state.view().entries().count() == 3 and state.page("txt", 1).total == 2
    state.refresh(spark.createDataFrame(rows[:0], ENTRY), 3)
    assert state.view().entries().count() == 0 and state.page("").total == 0
