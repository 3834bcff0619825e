"""Replays until the journal is quiet, their undo segments, and attempts that fail."""

import pytest

from pathloom.operators import journal
from pathloom.streaming import maintain, replay
from pathloom.streaming.store import NotReady, Store
from test_namespace import D, F_, RECORD, table

OLD = [(100, 5, "a", D), (200, 100, "x", F_), (101, 5, "b", D)]


def keys(rows):
    return sorted((r.object, r.parent, r.name) for r in rows.collect())


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "s"), most_versions=4)
    maintain.bootstrap(made, table(spark, OLD), "d:", "j", 10)
    return made


def told(spark, *rows):
    return spark.createDataFrame([("d:", u, o, p, 0x100, a, n) for u, o, p, n, a in rows], RECORD)


def test_records_that_arrive_during_a_replay_are_in_what_is_published(spark, store):
    """Each time the end is asked for, the journal has gone on, and so has the listing."""
    records = told(spark, (10, 201, 100, "y", F_), (20, 202, 101, "z", F_), (30, 102, 101, "c", D))
    listings = [OLD + [(201, 100, "y", F_)], OLD + [(201, 100, "y", F_), (202, 101, "z", F_)], OLD + [(201, 100, "y", F_), (202, 101, "z", F_), (102, 101, "c", D), (203, 102, "w", F_)]]
    ends, at = [11, 21, 31, 31], [0]

    def holds():
        at[0] += 1
        return "j", 0, 0, ends[min(at[0], 4) - 1]

    seen = []

    def listing():
        seen.append(store.versions())
        return table(spark, listings[min(at[0], 3) - 1])

    done = replay.Replay(store, listing, lambda a, b: records, holds).sync()
    assert (done.cursor, done.windows, done.records, done.attempts) == (31, 3, 3, 1)
    assert store.manifest().cursor == 31 and store.manifest().version == 2
    assert all(v == [1] for v in seen)  # nothing is published before the end is quiet
    assert keys(store.read()) == keys(table(spark, listings[-1]))
    assert keys(replay.undone(store, done.undo, store.read())) == keys(table(spark, OLD))
    replay.roll_back(store, done.undo, 10)
    assert store.manifest().cursor == 10 and keys(store.read()) == keys(table(spark, OLD))
    with pytest.raises(NotReady, match="another version"):
        replay.roll_back(store, done.undo, 10)


def test_a_listing_ahead_of_its_window_waits_for_more_records(spark, store):
    """The listing has a directory below one that only a later record tells of."""
    first, second = told(spark, (10, 300, 400, "deep", F_)), told(spark, (11, 400, 100, "new", D))
    now = table(spark, OLD + [(400, 100, "new", D), (300, 400, "deep", F_)])
    ends = [12, 12, 12, 11]
    done = replay.Replay(store, lambda: now, lambda a, b: first.unionByName(second), lambda: ("j", 0, 0, ends.pop())).sync()
    assert done.widened == 1 and done.cursor == 12 and keys(store.read()) == keys(now)


def test_failed_attempts_leave_the_store_and_are_counted(spark, store):
    bad = told(spark, (10, 300, 999, "lost", F_))
    asked = []

    def holds():
        asked.append(1)
        return "j", 0, 0, 11

    with pytest.raises(journal.ReconcileError, match="parent"):
        replay.Replay(store, lambda: table(spark, OLD), lambda a, b: bad, holds, attempts=2).sync()
    assert len(asked) == 4 and store.manifest().cursor == 10 and store._names("undo") == []
    with pytest.raises(journal.ReconcileError, match="does not hold"):
        replay.Replay(store, lambda: table(spark, OLD), lambda a, b: bad, lambda: ("other", 0, 0, 11)).sync()
    with pytest.raises(journal.ReplayBudgetError):
        replay.Replay(store, lambda: table(spark, OLD), lambda a, b: bad, lambda: ("j", 0, 0, 11), budget=10).sync()
    end = [10]

    def restless():
        end[0] += 1
        return "j", 0, 0, end[0]

    with pytest.raises(journal.ReconcileError, match="never quiet"):
        replay.Replay(store, lambda: table(spark, OLD), lambda a, b: told(spark, (5, 200, 100, "x", F_)), restless, most_windows=2, attempts=1).sync()
    assert store.versions() == [1]


def test_a_replay_that_changes_nothing_moves_the_cursor_alone(spark, store):
    same = told(spark, (10, 200, 100, "x", F_))
    done = replay.Replay(store, lambda: table(spark, OLD), lambda a, b: same, lambda: ("j", 0, 0, 11)).sync()
    assert done.undo is None and done.undo_entries == 0 and store.manifest().cursor == 11
    quiet = replay.Replay(store, lambda: table(spark, OLD), lambda a, b: same, lambda: ("j", 0, 0, 11)).sync()
    assert quiet.windows == 0 and store.manifest().version == 2


def many(spark):
    """More than 64 MB of records of a file, in long names."""
    rows = spark.range(1700).selectExpr("'d:' AS source", "id + 10 AS usn", "201L AS object", "100L AS parent", "256L AS reason", f"{F_} AS attributes", "repeat('x', 20000) AS name")
    assert rows.selectExpr("sum(60 + 2 * length(name))").first()[0] > 64 << 20
    return rows


NOW, UNTOLD = [*OLD, (201, 100, "y", F_)], (202, 101, "untold", F_)


def test_a_replay_reads_windows_of_any_size(spark, store):
    done = replay.Replay(store, lambda: table(spark, [*NOW, UNTOLD]), lambda a, b: many(spark), lambda: ("j", 0, 0, 1710)).sync()
    assert (done.cursor, done.records) == (1710, 1700) and keys(store.read()) == keys(table(spark, NOW))


def test_batches_of_any_size_are_applied_without_a_rebuild(spark, store):
    m = maintain.Maintainer(store, lambda: table(spark, [*NOW, UNTOLD]))
    m(many(spark), 0)
    assert (m.applied, m.rebuilt) == (1, 0) and keys(store.read()) == keys(table(spark, NOW))
    strict = maintain.Maintainer(store, lambda: table(spark, [*NOW, UNTOLD]), budget=10)
    strict(many(spark).selectExpr("source", "usn + 1700 AS usn", "object", "parent", "reason", "attributes", "name"), 1)
    assert strict.rebuilt == 1 and keys(store.read()) == keys(table(spark, [*NOW, UNTOLD]))
