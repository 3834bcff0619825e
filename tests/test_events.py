"""Notices that can't be read, kinds of losses, and inventories that follow batches of changes."""

import struct

import pytest
from pyspark.sql import functions as F

from pathloom.operators import journal
from pathloom.sources import usn
from pathloom.streaming import pairing
from pathloom.streaming.events import Follower
from pathloom.streaming.store import NotReady, Store


def notice(name, action=1, following=None, size=None, last=False):
    raw = name.encode("utf-16-le", "surrogatepass")
    whole = -(-(12 + len(raw)) // 4) * 4
    return struct.pack("<III", 0 if last else (whole if following is None else following), action, len(raw) if size is None else size) + raw.ljust(whole - 12, b"\0")


@pytest.mark.parametrize(
    "bad",
    [
        notice("x", size=0), notice("x", size=3), notice("x" * 2049, last=True), notice("abc", size=400, last=True), notice("x", following=6), notice("abcdef", following=16),
        notice("x", following=4000), notice("x", last=True) + b"\0" * 4, b"\0" * 11, notice("x"), notice("a:b", last=True), notice("a\0", last=True), notice("a//b", last=True),
        notice("\\a", last=True), notice("a\\..\\b", last=True), notice("./a", last=True), notice("a/", last=True),
    ],
)
def test_a_malformed_notice_is_a_loss_and_what_came_before_counts(bad):
    good = notice("fine\\one", 4)
    assert usn.decode_notices(good + bad) == ([(4, "fine\\one")], "invalid_event")
    assert usn.decode_notices(bad) == ([], "invalid_event")


def test_buffers_have_an_end():
    assert usn.decode_notices(b"") == ([], None) and usn.decode_notices(notice("a", last=True)) == ([(1, "a")], None)
    assert usn.decode_notices(notice("a") * 4 + notice("b", last=True), 4) == ([(1, "a")] * 4, "user_overflow")
    assert usn.decode_notices(notice("\ud800x", last=True)) == ([(1, None)], None)


def entry(name, identity=9, last=True):
    raw = name.encode("utf-16-le")
    size = -(-(104 + len(raw)) // 8) * 8
    data = bytearray(size)
    struct.pack_into("<I", data, 0, 0 if last else size)
    struct.pack_into("<II", data, 56, 32, len(raw))
    struct.pack_into("<Q", data, 96, identity)
    data[104 : 104 + len(raw)] = raw
    return bytes(data)


@pytest.mark.parametrize("bad", [entry("a\0b"), entry("a/b"), entry("a\\b"), entry("a", 0), entry("x" * 256), entry("a")[:100], entry("a", last=False), entry("")])
def test_a_wrong_listing_entry_refuses_the_buffer(bad):
    assert usn.decode_listing(entry(".", 0, False) + entry("..", 0, False) + entry("é" * 255), 5) == [(9, 5, 32, ("é" * 255).encode("utf-16-le"))]
    for data in (bad, entry("ok", last=False) + bad):
        with pytest.raises(usn.RecordError):
            usn.decode_listing(data, 5)


def test_losses_by_kind_and_pairs_over_batches(spark, tmp_path):
    rows = [
        ("s", 0, 0, "old", "a"), ("s", 1, 10, "new", "b"), ("s", 2, 20, "lost", "invalid_event"), ("s", 3, 30, "old", "c"), ("s", 4, 40, "lost", "user_overflow"),
        ("s", 5, 50, "new", "d"), ("t", 0, 0, "old", "e"), ("t", 1, 60, "modified", "f"), ("t", 2, 70, "old", "g"), ("u", 0, 5, "old", "h"),
    ]
    df = spark.createDataFrame(rows, pairing.NOTICES)
    want = {("s", 1, "rename", "b", "a", False), ("s", 2, "loss", None, "invalid_event", True), ("s", 3, "loss", "c", None, True), ("s", 4, "loss", None, "user_overflow", True),
            ("s", 5, "loss", "d", None, True), ("t", 0, "loss", "e", None, True), ("t", 1, "refresh", "f", None, False), ("t", 2, "loss", "g", None, True), ("u", 0, "loss", "h", None, True)}
    assert {tuple(r) for r in journal.rename_pairs(df).collect()} == want
    verdict = pairing.batch_verdict(journal.rename_pairs(df))
    assert verdict == {"apply": False, "losses": 7, "kinds": ["invalid_event", "unpaired_rename", "user_overflow"], "overflow": False}
    assert pairing.batch_verdict(journal.rename_pairs(df).limit(0)) == {"apply": True, "losses": 0, "kinds": [], "overflow": False}
    told = {}
    pairs = pairing.Pairs(spark, str(tmp_path / "p"), lambda c, e: told.__setitem__(e, [tuple(r) for r in c.collect()]), wait_ms=60)
    for epoch, seqs in enumerate(([0], [1, 2, 3], [4, 5])):
        batch = df.where(F.col("seq").isin(seqs))
        pairs(batch, epoch)
        again = told.pop(epoch)
        pairs(batch, epoch)  # a restart repeats it
        assert sorted(told[epoch], key=repr) == sorted(again, key=repr)
    assert ("u", 0, "loss", "h", None, True) not in told[0]  # waits until the others' time has gone on
    done = [r for rows in told.values() for r in rows]
    waits = {(r.source, r.seq) for r in pairs.waiting(2).collect()}
    assert len(done) == len(set(done)) and set(done) == {r for r in want if r[:2] not in waits} and waits == {("t", 2)}


def test_an_inventory_follows_changes_and_is_corrected_after_losses(spark, tmp_path):
    form = "path string, kind string"
    now = {"df": spark.createDataFrame([("a", "directory"), ("a/x", "file"), ("c", "file")], form)}
    follower = Follower(Store(spark, str(tmp_path / "i")), lambda: now["df"], most=3)
    changes = lambda *rows: spark.createDataFrame(rows, pairing.CHANGES)
    with pytest.raises(NotReady):
        follower(changes(), 0)
    follower.bootstrap()
    rows = lambda: {tuple(r) for r in follower.store.read().collect()}
    now["df"] = spark.createDataFrame([("b", "directory"), ("b/x", "file"), ("d", "file"), ("untold", "file")], form)
    follower(changes(("", 1, "rename", "b", "a", False), ("", 2, "remove", "c", None, False), ("", 3, "refresh", "d", None, False)), 0)
    assert rows() == {("b", "directory"), ("b/x", "file"), ("d", "file")} and (follower.applied, follower.corrected) == (1, 0)
    before = follower.store.manifest()
    follower(changes(("", 1, "remove", "b", None, False)), 0)  # the same epoch again
    assert follower.store.manifest() == before
    follower(changes(("", 4, "refresh", "d", None, False)), 1)
    assert follower.unchanged == 1 and follower.store.manifest().cursor == 2
    follower(changes(("", 5, "remove", "d", None, False), ("", 6, "loss", "z", None, True), ("", 7, "loss", None, "invalid_event", True)), 2)
    assert ("untold", "file") in rows() and ("d", "file") in rows() and follower.corrected == 1 and follower.store.manifest().cursor == 3
    now["df"] = now["df"].where("path <> 'untold'")
    follower(changes(*[("", k, "refresh", "d", None, False) for k in range(4)]), 3)
    follower(changes(("", 9, "remove", "../d", None, False)), 4)
    assert follower.losses == {"invalid_event": 1, "unpaired_rename": 1, "overflow": 1, "dependent": 1} and follower.corrected == 3
    assert ("untold", "file") not in rows() and follower.store.verify()
