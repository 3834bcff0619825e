"""Stores, streams and their recovery; binary records; the service's messages."""

import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from pathloom import service
from pathloom.operators import journal
from pathloom.plans import search
from pathloom.sources import usn
from pathloom.streaming import maintain, pairing
from pathloom.streaming.store import NotReady, Store
from test_namespace import D, F_, table


def test_store_versions_leases_and_crashes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), most_versions=3)
    rows = spark.range(3)
    assert store.status()["state"] == "empty"
    assert store.publish(rows, store.ticket(), "d:", "j", 10).version == 1
    lease = store.lease()
    rows.write.parquet(str(tmp_path / "s/v=2-crash"))  # a crash before the manifest
    assert store.read().count() == 3 and store.manifest().version == 1
    assert store.publish(spark.range(5), store.ticket(), "d:", "j", 20).cursor == 20
    assert store.read().count() == 5 and store.leased(lease).count() == 3
    old = store.ticket()
    store.signal()
    with pytest.raises(NotReady, match="overtaken"):
        store.publish(spark.range(9), old, "d:", "j", 30)
    assert store.read().count() == 5

    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.publish(spark.range(9), store.ticket(), "d:", "j", 30, refuse)
    assert store.status()["state"] == "failed" and store.manifest().cursor == 20
    store.publish(spark.range(6), store.ticket(), "d:", "j", 30)
    assert store.versions() == [1, 2, 3] or store.versions() == [1, 3]
    store.release(lease)
    store.vacuum()
    assert store.versions() == [3]
    again = Store(spark, str(tmp_path / "s"))
    assert again.read().count() == 6 and again.manifest().cursor == 30
    store.stop()
    with pytest.raises(NotReady):
        store.publish(rows, store.ticket(), "d:", "j", 40)
    assert store.read().count() == 6


def test_readers_hold_back_publication(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for cursor in (1, 2):
        store.publish(spark.range(cursor), store.ticket(), "d:", "j", cursor)
        lease = store.lease()
    with pytest.raises(NotReady, match="readers_pinned"):
        store.publish(spark.range(3), store.ticket(), "d:", "j", 3)
    assert store.leased(lease).count() == 2


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    old = table(spark, [(100, 5, "a", D), (200, 100, "f", F_), (102, 5, "b", D)])
    now = table(spark, [(100, 5, "a", D), (200, 102, "f", F_), (102, 5, "b", D), (103, 102, "new", D), (201, 103, "g", F_)])
    store = Store(spark, str(tmp_path / "s"))
    maintain.bootstrap(store, old, "d:", "j", 0)
    folder = str(tmp_path / "j")
    ts = "timestamp'2024-01-01' as ts"

    def add(rows):
        df = spark.createDataFrame([("d:", *r) for r in rows], "source string, usn long, object long, parent long, reason long, attributes int, name string")
        df.selectExpr("source", "usn", ts, "object", "parent", "reason", "attributes", "name").coalesce(1).write.mode("append").parquet(folder)

    first = [(1, 200, 102, 0x2000, F_, "f")]
    second = [(2, 103, 102, 0x100, D, "new"), (3, 201, 103, 0x100, F_, "g")]
    add(first)
    m = maintain.Maintainer(store, lambda: now)
    maintain.follow(spark, folder, m, str(tmp_path / "c"), files=1).awaitTermination(120)
    assert store.manifest().cursor == 2 and m.applied == 1
    add(second)
    m2 = maintain.Maintainer(Store(spark, str(tmp_path / "s")), lambda: now)
    maintain.follow(spark, folder, m2, str(tmp_path / "c"), files=1).awaitTermination(120)
    m2(spark.read.parquet(folder), 99)  # a replayed batch does nothing
    got = store.read()
    assert store.manifest().cursor == 4
    want = journal.applied(old, spark.read.parquet(folder).drop("ts"), now)
    columns = ["object", "parent", "name", "attributes"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == want.select(columns).exceptAll(got.select(columns)).count() == 0
    add([(9, 300, 555, 0x100, F_, "unknown parent")])
    maintain.follow(spark, folder, m2, str(tmp_path / "c")).awaitTermination(120)
    assert m2.rebuilt == 1 and store.manifest().cursor == 10


def test_rename_pairing_stream_equals_batch(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(f"s{k % 3}", k, k * 60 + rng.randint(0, 50), rng.choice(["old", "new", "removed", "modified", "old", "new"]), f"p{k}") for k in range(300)]
    df = spark.createDataFrame(rows, pairing.NOTICES)
    folder = str(tmp_path / "n")
    for lo, hi in ((0, 100), (100, 200), (200, 300)):
        df.where((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(pairing.NOTICES).option("maxFilesPerTrigger", 1).parquet(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    out = pairing.rename_stream(stream, 250, None).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "o"))
    out.trigger(availableNow=True).start().awaitTermination(180)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {tuple(r) for r in spark.read.schema(pairing.CHANGES).parquet(str(tmp_path / "o")).select("source", "seq", "kind", "path", "source_path", "loss").collect()}
    want = {tuple(r) for r in journal.rename_pairs(df, 250).collect()}
    waiting = {r[:2] for r in rows if r[3] == "old" and not any(o[0] == r[0] and o[1] > r[1] for o in rows)}
    assert got == {r for r in want if r[:2] not in waiting}
    assert any(r[2] == "rename" for r in got) and any(r[5] for r in got)


def test_rename_pairing_times():
    old, new = (1, 0, "old", "a"), (2, 99, "new", "b")
    assert pairing.paired([old, new], None) == ([(2, "rename", "b", "a", False)], None)
    assert pairing.paired([old, (2, 100, "new", "b")], None)[0] == [(1, "loss", "a", None, True), (2, "loss", "b", None, True)]
    assert pairing.paired([old], None) == ([], (1, 0, "a"))
    assert pairing.paired([new], (1, 0, "a"))[0][0][1] == "rename"


def record(major=2, **change):
    data = bytearray(usn.encode([(70, 5, 12, 0x100, 32, "näme".encode("utf-16-le"))], major))
    for offset, (form, value) in change.items():
        struct.pack_into(form, data, int(offset[1:]), value)
    return bytes(data)


def fields(major):
    """(name, offset, struct code) of every field, from the declared layout."""
    at, out = 0, []
    for name, code in zip(usn.FIELDS.split(), re.findall(r"\d*[a-zA-Z]", usn.FORMS[major].format)):
        out.append((name, at, f"<{code}"))
        at += struct.calcsize(f"<{code}")
    return out


BAD = {
    "length": [0, 59, 61, 4096, 1 << 31], "major": [0, 1, 4, 9], "minor": [1, 7], "name_bytes": [0, 1, 9, 512, 4096],
    "name_at": [0, 2, 59, 61, 63, 200],
}


@pytest.mark.parametrize("name,value", [(k, v) for k, values in BAD.items() for v in values])
def test_one_bad_field_refuses_the_batch(name, value):
    offset, code = next((at, c) for n, at, c in fields(2) if n == name)
    for first in (b"", record()):
        with pytest.raises(usn.RecordError):
            usn.decode(first + record(**{f"_{offset}": (code, value)}))


@pytest.mark.parametrize("bad", ["a/b", "a\\b", "\0", "x\0"])
def test_a_forbidden_unit_refuses_the_batch(bad):
    with pytest.raises(usn.RecordError, match="name"):
        usn.decode(usn.encode([(70, 5, 12, 0, 32, bad.encode("utf-16-le"))]))


def test_lengths_of_batches():
    one = record()
    for cut in range(1, len(one)):
        with pytest.raises(usn.RecordError):
            usn.decode(one[:cut])
        with pytest.raises(usn.RecordError):
            usn.decode(one + one[:cut])
    assert usn.decode(b"") == [] and len(usn.decode(one * 3)) == 3
    wide = usn.encode([((1 << 100) + 9, 5, 12, 1, 32, b"x\0")], 3)
    assert usn.decode(wide, (3,))[0][0] == (1 << 100) + 9
    with pytest.raises(usn.RecordError, match="major"):
        usn.decode(wide)


def test_records_decode(spark):
    lone = b"\x00\xd8" + "x".encode("utf-16-le")
    data = record() + usn.encode([(71, 70, 13, 0x2000, 16, lone)])
    rows = usn.records(spark.createDataFrame([(1, bytearray(data)), (2, None)], "batch_id long, data binary")).collect()
    assert [(int.from_bytes(r.object, "big"), r.usn, r.reason, r.name) for r in rows] == [(70, 12, 0x100, "näme"), (71, 13, 0x2000, None)]
    assert usn.decode(record(3), (2, 3))[0][0] == 70
    with pytest.raises(usn.RecordError):
        usn.decode(b"\0" * 7)
    with pytest.raises(usn.RecordError):
        usn.decode(record() * 2000)


def test_requests_are_strict():
    assert service.request('{"op":"query","query":"a"}') == {"op": "query", "query": "a", "filter": "all", "limit": 20}
    bad = ['{"op":"query","query":"a","x":1}', '{"op":"query","query":"a","limit":0}', '{"op":"query","query":"a","limit":101}', '{"op":"query","query":"a\\u0000"}', '{"op":"drop"}', '{"op":"query","query":"a","filter":"pics"}', '{"op":"status","query":"a"}', "[]"]
    for b in bad:
        with pytest.raises(ValueError):
            service.request(b)


def test_responses_fit_their_frame(spark):
    item = lambda n: {"path": "p" * n, "name": "n", "is_directory": False}
    r = {"ready": True, "pending": False, "error": "é" * 4000, "version": 1, "total": 3, "total_exact": True, "skipped": 0, "files": [item(10), item(70_000), item(20)]}
    out = service.bounded(r)
    assert [len(f["path"]) for f in out["files"]] == [10, 20] and not out["total_exact"] and "1 of 3 results do not fit" in out["error"]
    assert len(json.dumps(out, ensure_ascii=False).encode()) <= service.FRAME and len(out["error"].encode()) <= 4096
    page = search.page(table(spark, [(100, 5, "a", D), (200, 100, "f.txt", F_)]), "f", 5)
    got = service.respond(page, 7)
    assert got["files"] == [{"path": "d:/a/f.txt", "name": "f.txt", "is_directory": False}] and got["total"] == 1 and got["version"] == 7
    assert service.described(got) == "1 results"
    assert service.lines(["a\nb", "c"]) == "a\\nb\nc\n" and service.lines(["a\nb"], True) == "a\nb\0"


def test_journal_files_to_rows(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/1.bin").write_bytes(record())
    (tmp_path / "b/2.bin").write_bytes(usn.encode([((1 << 63) + 7, 70, 13, 0x2000, 16, "x".encode("utf-16-le"))]))
    rows = usn.journal_rows(usn.files(spark, str(tmp_path / "b")), "d:").orderBy("usn").collect()
    assert [(r.object, r.parent, r.usn, r.name) for r in rows] == [(70, 5, 12, "näme"), (7 - (1 << 63), 70, 13, "x")]
    wide = usn.encode([(1 << 80, 5, 1, 0, 0, b"x\0")], 3)
    df = usn.records(spark.createDataFrame([(1, bytearray(wide))], "batch_id long, data binary"), (3,))
    with pytest.raises(Exception, match="wider"):
        usn.journal_rows(df, "d:").collect()


def test_notices_and_listings_decode():
    name = "a".encode("utf-16-le")
    one = struct.pack("<III", 16, 4, 2) + name + b"\0\0" + struct.pack("<III", 0, 5, 2) + name
    assert usn.decode_notices(one) == ([(4, "a"), (5, "a")], None)
    assert usn.decode_notices(one[:-1]) == ([(4, "a")], "invalid_event")
    entry = bytearray(112)
    struct.pack_into("<II", entry, 56, 16, 2)
    struct.pack_into("<Q", entry, 96, 77)
    entry[104:106] = name
    dot = bytearray(entry)
    dot[104:106] = b".\0"
    struct.pack_into("<I", dot, 0, 112)
    assert usn.decode_listing(bytes(dot) + bytes(entry), 5) == [(77, 5, 16, name)]


def test_batches_of_changes(spark):
    from pathloom.operators import inventory

    inv = spark.createDataFrame([("a", "directory"), ("a/x", "file"), ("c", "file")], "path string, kind string")
    now = spark.createDataFrame([("b", "directory"), ("b/x", "file"), ("d", "file")], "path string, kind string")
    form = "seq int, kind string, path string, source string, target string"
    changes = spark.createDataFrame([(1, "rename", None, "a", "b"), (2, "remove", "c", None, None), (3, "refresh", "d", None, None)], form)
    assert {tuple(r) for r in inventory.applied(inv, changes, now).collect()} == {tuple(r) for r in now.collect()}
    for bad in ([(1, "refresh", "../a", None, None)], [(1, "rename", None, "c", "b")], [(1, "remove", "a/x", None, None), (2, "rename", None, "a", "b")]):
        with pytest.raises(inventory.CorrectionNeeded):
            inventory.applied(inv, spark.createDataFrame(bad, form), now)


def in_order(inv, changes, now):
    """A batch of changes one after the other over plain dictionaries {path: kind}; None if it must be corrected."""
    below = lambda x, top: x == top or x.startswith(f"{top}/")
    meet = lambda a, b: below(a, b) or below(b, a)
    for k, (_, kind, path, source, target) in enumerate(changes):
        earlier = [p for c in changes[:k] for p in c[2:] if p]
        if kind == "rename" and (source != target and meet(source, target) or now.get(target) == "directory" and any(meet(source, p) for p in earlier)):
            return None
    for _, kind, path, source, target in changes:
        def without(top):
            return {p: x for p, x in inv.items() if not below(p, top)}

        def listed(top):
            return without(top) | {p: x for p, x in now.items() if below(p, top)}

        if kind == "remove":
            inv = without(path)
        elif kind == "refresh":
            inv = listed(path)
        elif source != target and now.get(target) is None:
            inv = without(source)
        elif source != target and inv.get(source) is None:
            inv = listed(target)
        elif source != target and inv[source] != now[target]:
            return None
        elif source != target:
            gone = without(target)
            inv = {(target + p[len(source) :] if below(p, source) else p): x for p, x in gone.items()}
    return inv


def test_batches_as_sets_equal_one_change_after_the_other(spark):
    import random

    from pathloom.operators import inventory

    rng, form, fine, refused = random.Random(8), "seq int, kind string, path string, source string, target string", 0, 0

    def tree():
        dirs = ["a", "b", "c"] + [d for p in "abc" for d in (f"{p}/d", f"{p}/e") if rng.random() < 0.6]
        return {d: "directory" for d in dirs} | {f"{d}/f{k}": "file" for d in dirs for k in range(3) if rng.random() < 0.6} | {f"r{k}": "file" for k in range(4) if rng.random() < 0.7}

    for _ in range(14):
        old, now = tree(), tree()
        some = sorted({*old, *now, "new", "a/new"})
        pick = lambda: rng.choice(some)
        changes = []
        for k in range(rng.randint(1, 7)):
            kind = rng.choice(["remove", "refresh", "rename", "rename"])
            changes.append((k, kind, None, pick(), pick()) if kind == "rename" else (k, kind, pick(), None, None))
        want = in_order(old, changes, now)
        a, b = (spark.createDataFrame(list(x.items()), "path string, kind string") for x in (old, now))
        try:
            got = dict(map(tuple, inventory.applied(a, spark.createDataFrame(changes, form), b).collect()))
        except inventory.CorrectionNeeded:
            got = None
        assert got == want, changes
        fine, refused = fine + (want is not None), refused + (want is None)
    assert fine > 3 and refused > 1
    many = spark.range(100_000).selectExpr("cast(id as int) as seq", "case when id % 2 = 0 then 'remove' else 'refresh' end as kind", "concat('a/f', id) as path", "cast(null as string) as source", "cast(null as string) as target")
    with pytest.raises(inventory.CorrectionNeeded):
        inventory.applied(a, many, b)
    old = many.select("path", F.lit("file").alias("kind"))
    assert inventory.applied(old, many, old, most=None).count() == 50_000


def test_frames_rpc_and_dispatch():
    import io

    pipe = io.BytesIO()
    service.write_frame(pipe, {"op": "status"})
    pipe.seek(0)
    assert service.dispatch(service.read_frame(pipe), lambda q: {}, lambda: {"error": None, "files": [], "ready": True})["ready"]
    assert "invalid" in service.dispatch(b'{"op":"x"}', lambda q: {}, lambda: {})["error"]
    for bad in (b"\0\0\0\0", b"\xff\xff\xff\x7f", b"\x05\0\0\0ab"):
        with pytest.raises(ValueError):
            service.read_frame(io.BytesIO(bad))
    answer = lambda q, o: {"files": [{"name": q, "path": f"d:/{q}"}]}
    assert service.rpc({"id": 1, "method": "plugin/query", "params": {"query": "x"}}, answer)["result"]["items"][0]["title"] == "x"
    assert "error" in service.rpc({"id": 1, "method": "plugin/nothing"}, answer) and service.rpc({"method": "plugin/dispose"}, answer) is None
    ask = lambda action, payload: service.rpc({"id": 2, "method": "plugin/execute", "params": {"action_id": action, "payload": payload}}, answer, lambda: service.unavailable("off"))
    assert ask("show_status", {})["result"]["text"] == "unavailable: off" and ask("show_status", None) == ask("show_status", {})
    assert "error" in ask("show_status", {"path": "x"}) and "error" in ask("install_service", {})
    assert [service.backoff_ms(n) for n in (0, 1, 3, 9)] == [250, 500, 2000, 2000]


def test_command_line_and_background_count(spark, tmp_path, capsys):
    from pathloom import cli
    from pathloom.plans.jobs import CountJob

    path = str(tmp_path / "s")
    assert cli.main(["--store", path, "query", "x"], spark) == 1
    store = Store(spark, path)
    maintain.bootstrap(store, table(spark, [(100, 5, "a", D), (200, 100, "f.txt", F_)]), "d:", "j", 3)
    assert cli.main(["--store", path, "query", "--type", "files", "--limit", "5", "F"], spark) == 0
    assert capsys.readouterr().out.endswith("d:/a/f.txt\n")
    assert cli.main(["--store", path, "query", "--limit", "0", "f"], spark) == 2 and cli.main(["--store", path, "query"], spark) == 2
    assert store.sparse() is False and store.compact(1).cursor == 3 and store.read().count() == 2
    job = CountJob(store.read())
    assert job.wait(60) == 2 and job.state == "complete" and job.progress() == 1.0
    stopped = CountJob(store.read())
    stopped.cancel()
    stopped.wait(60)
    assert (stopped.state, stopped.count) in (("cancelled", None), ("complete", 2))



def test_checksums_shards_and_audits(spark, tmp_path):
    from pathloom.streaming.store import changed_shards, overwrite_shards

    old = table(spark, [(100, 5, "a", D), (200, 100, "f.txt", F_)])
    new = table(spark, [(100, 5, "a", D), (201, 100, "g.txt", F_)])
    store = Store(spark, str(tmp_path / "s"))
    maintain.bootstrap(store, old, "d:", "j", 3)
    assert store.verify()
    assert not maintain.Maintainer(store, lambda: old).audit() and store.manifest().version == 1
    assert maintain.Maintainer(store, lambda: new).audit() and store.manifest().version == 2 and store.verify()
    store.read().limit(1).write.mode("append").parquet(store.folders()[0])
    assert not store.verify()
    a = spark.createDataFrame([(f"p{k}", "file") for k in range(300)], "path string, kind string")
    b = a.where("path <> 'p7'").unionByName(spark.createDataFrame([("q", "file")], a.schema))
    path, every = str(tmp_path / "shards"), spark.range(64).select(F.col("id").cast("int").alias("shard"))
    overwrite_shards(a, every, path)
    changed = changed_shards(a, b)
    assert 1 <= changed.count() <= 2 and changed_shards(a, a).count() == 0
    overwrite_shards(b, changed, path)
    got = spark.read.parquet(path).select("path", "kind")
    assert got.exceptAll(b).count() == b.exceptAll(got).count() == 0


def test_raw_literals_order_and_export(spark, tmp_path):
    from pathloom.functions.query import raw_literal, unit_order

    names = ["ab", "\u6100b", "a\u0062", "\ue000", "\U00010000"]
    raw = spark.createDataFrame([(n, bytearray(n.encode("utf-16-le"))) for n in names], "name string, raw binary")
    got = [r.name for r in raw.where(raw_literal(F.col("raw"), "b".encode("utf-16-le"))).collect()]
    assert got == ["ab", "\u6100b", "ab"]
    assert raw.where(raw_literal(F.col("raw"), b"\x61\x62")).count() == 0  # a unit of its own, not two halves
    assert raw.where(raw_literal(F.col("raw"), b"")).count() == 5
    assert [r.name for r in raw.orderBy(unit_order(F.col("name"))).collect()][-2:] == ["\U00010000", "\ue000"]
    rows = spark.createDataFrame([(1, "a/b\nc"), (2, "x")], "id long, path string")
    search.export(rows, "a/", str(tmp_path / "lines"))
    search.export(rows, "", str(tmp_path / "nul"), nul=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a/b\\nc"]
    assert sum(p.read_bytes().count(b"\0") for p in (tmp_path / "nul").glob("part-*")) == 2


def test_racing_writers_leave_one_version(spark, tmp_path):
    """Both hold the same ticket and both write; the manifest of the first stays, with its rows."""
    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.publish(spark.range(2), a.ticket(), "d:", "j", 1)
    ticket = b.ticket()

    def meanwhile(rows):
        a.publish(spark.range(3), a.ticket(), "d:", "j", 2)

    with pytest.raises(NotReady, match="overtaken"):
        b.publish(spark.range(7), ticket, "d:", "j", 2, meanwhile)
    assert a.read().count() == 3 and a.verify() and b.manifest() == a.manifest()
    with pytest.raises(NotReady, match="overtaken"):
        a._put("manifests/000000000002.json", "{}")
    assert a.verify()


def test_shards_that_became_empty_and_repeated_rows(spark, tmp_path):
    from pathloom.streaming.store import changed_shards, checksum, overwrite_shards

    form, path = "path string, kind string", str(tmp_path / "t")
    two = spark.createDataFrame([("a", "file"), ("b", "file")], form)
    overwrite_shards(two, spark.range(64).select(F.col("id").cast("int").alias("shard")), path)
    one = two.where("path = 'a'")
    overwrite_shards(one, changed_shards(two, one), path)
    assert [r.path for r in spark.read.parquet(path).collect()] == ["a"]
    x, y = (spark.createDataFrame([("a", k), ("a", k)], form) for k in ("file", "directory"))
    assert changed_shards(x, y).count() == 1 and checksum(x) != checksum(y)


def small_tree(spark, source, extra=()):
    rows = [(100, 5, "a", D), (102, 5, "b", D), *[(200 + k, 100 + 2 * (k % 2), f"f{k}", F_) for k in range(40)], *extra]
    return table(spark, rows).withColumn("source", F.lit(source))


def journal_rows(spark, rows):
    return spark.createDataFrame(rows, "source string, usn long, object long, parent long, reason long, attributes int, name string")


def test_a_batch_writes_only_its_shards_and_its_source(spark, tmp_path):
    now = {s: small_tree(spark, s, [(300, 102, "new", F_)]) for s in ("d:", "e:")}
    both = now["d:"].unionByName(now["e:"])
    stores = {s: Store(spark, str(tmp_path / s[0])) for s in now}
    for s, store in stores.items():
        maintain.bootstrap(store, small_tree(spark, s), s, "j", 7)
        with pytest.raises(NotReady, match="already"):
            maintain.bootstrap(store, small_tree(spark, s), s, "k", 0)
        assert store.manifest().cursor == 7
    ms = {s: maintain.Maintainer(store, lambda: both) for s, store in stores.items()}
    run = maintain.each(list(ms.values()))
    before = stores["d:"].manifest()
    run(journal_rows(spark, [("e:", 50, 300, 102, 0x100, F_, "new")]), 0)
    assert stores["d:"].manifest() == before and stores["e:"].manifest().cursor == 51
    run(journal_rows(spark, [("d:", 9, 300, 102, 0x100, F_, "new")]), 1)
    after = stores["d:"].manifest()
    changed = {k for k in before.parts.keys() | after.parts.keys() if before.parts.get(k) != after.parts.get(k)}
    assert after.cursor == 10 and len(changed) == 1 and stores["d:"].verify() and ms["d:"].applied == 1
    run(journal_rows(spark, [("d:", 12, 300, 102, 0x100, F_, "new")]), 2)
    assert stores["d:"].manifest().parts == after.parts and stores["d:"].manifest().cursor == 13 and ms["d:"].unchanged == 1
    columns = ["object", "parent", "name", "attributes"]
    assert not stores["d:"].read().select(columns).exceptAll(now["d:"].select(columns)).head(1)


@pytest.mark.parametrize("holds,rebuilt", [(("j", 0, 0, 99), 0), (("other", 0, 0, 99), 1), (("j", 50, 0, 99), 1), (("j", 0, 50, 99), 1), (("j", 0, 0, 5), 1)])
def test_a_cursor_that_is_not_retained_leads_to_a_rebuild(spark, tmp_path, holds, rebuilt):
    store = Store(spark, str(tmp_path / "s"))
    maintain.bootstrap(store, small_tree(spark, "d:"), "d:", "j", 7)
    now = small_tree(spark, "d:", [(300, 102, "new", F_)])
    m = maintain.Maintainer(store, lambda: now, holds=lambda: holds)
    m(journal_rows(spark, [("d:", 9, 300, 102, 0x100, F_, "new")]), 0)
    assert m.rebuilt == rebuilt and store.read().count() == now.count()
    assert (store.manifest().journal, store.manifest().cursor) == ((holds[0], holds[3]) if rebuilt else ("j", 10))


def test_touched_parents_are_checked_with_their_chains(spark):
    from pathloom.operators import namespace

    rows = [(100, 5, "a", D), (101, 100, "b", D), (200, 101, "f", F_), (900, 901, "x", D), (901, 900, "y", D), (201, 901, "g", F_), (202, 777, "h", F_)]
    t = table(spark, rows)
    for parent, bad in ((101, 0), (901, 1), (777, 1), (5, 0)):
        touched = spark.createDataFrame([("d:", parent)], "source string, parent long")
        got = {r["check"]: r.n for r in namespace.violations_at(t, touched).collect()}
        assert (got["unreachable"] > 0) == bool(bad) and got["bad_row"] == got["repeated_name"] == got["directory_names"] == 0


def test_directories_are_refreshed_below_changes_only(spark):
    from pathloom.operators import namespace

    old = table(spark, [(100, 5, "a", D), (101, 100, "b", D), (102, 101, "c", D), (103, 5, "d", D), (104, 103, "e", D), (105, 104, "f", D), (106, 5, "gone", D), (107, 106, "h", D)])
    new = table(spark, [(100, 103, "moved", D), (101, 100, "b", D), (102, 101, "c2", D), (103, 5, "d", D), (104, 103, "e", D), (105, 104, "f", D), (108, 102, "fresh", D), (107, 106, "h", D), (109, 110, "r", D), (110, 109, "s", D)])
    known = namespace.directories(old)
    got = {tuple(r) for r in namespace.refreshed_directories(known, old, new).collect()}
    assert got == {tuple(r) for r in namespace.directories(new).collect()} and len(got) == 8
    assert namespace.refreshed_directories(known, old, old) is known
