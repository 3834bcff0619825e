"""A journal's segments are read in many partitions, and a batch of them once."""

import json
import os
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pathloom.sources import feed, usn

LISTED = "source string, object long, parent long, name string, attributes int, slot long"


def batch(first, n=4):
    return usn.encode([(100 + at, 5 + at % 3, at, 0x100, 32, f"n{at}".encode("utf-16-le")) for at in range(first, first + n)])


@pytest.fixture
def journal(tmp_path):
    """400 records in batches of 4: a file with 10 row groups, a file with one, in one segment; small ones in another; files that are no records."""
    path = tmp_path / "j"
    for segment, name, first, following, size in (("0-300", "a", 0, 200, 5), ("0-300", "b", 200, 300, 50), ("300-400", "a", 300, 320, 5), ("300-400", "b", 320, 400, 50)):
        os.makedirs(path / "segments" / segment, exist_ok=True)
        pq.write_table(pa.table({"data": [batch(k) for k in range(first, following, 4)]}), path / "segments" / segment / f"{name}.parquet", row_group_size=size, use_dictionary=name == "a")
    (path / "segments" / "0-300" / "_SUCCESS").write_text("")
    (path / "bounds.json").write_text(json.dumps({"journal": "j", "first": 0, "lowest": 0, "next": 400}))
    return str(path)


def offset(at, journal="j"):
    return {"journal": journal, "usn": at}


@pytest.mark.parametrize("split", [100, 700, 1 << 20])
def test_segments_are_read_in_partitions_by_size(journal, monkeypatch, split):
    monkeypatch.setattr(feed, "SPLIT_BYTES", split)
    reader = feed.Reader({"path": journal, "source": "s"})

    def usns(low, high):
        parts = [[r for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions(offset(low), offset(high))]
        return [[r["usn"] for r in part] for part in parts if part], [r for part in parts for r in part]

    parts, rows = usns(0, 400)
    assert sorted(sum(parts, [])) == list(range(400))  # each record once, wherever the cuts are
    assert len(parts) > 6 if split == 100 else len(parts) > 3 if split == 700 else len(parts) == 1
    assert [r for r in rows if r["usn"] == 7] == [{"source": "s", "usn": 7, "ts": None, "object": 107, "parent": 6, "reason": 256, "attributes": 32, "name": "n7"}]
    assert sorted(sum(usns(150, 310)[0], [])) == list(range(150, 310))
    assert [r for p in reader.partitions(offset(0, "other"), offset(400)) for b in reader.read(p) for r in b.to_pylist()] == [dict.fromkeys(rows[0]) | {"source": "s"}]


def test_partitions_stay_bounded_in_number():
    files = [(f"f{k}", 1000) for k in range(50)]
    for split, most in ((100, 1 << 14), (100, 20), (100_000, 20), (2500, 1000)):
        got = feed.stretches(files, split, most)
        assert [sum(h - low for f, low, h in sum(got, []) if f == name) for name, _ in files] == [1000] * 50
        assert max(sum(h - low for _, low, h in part) for part in got) <= max(split, 2500) and len(got) <= max(2 * most, 1)
    assert feed.stretches([], 100, 20) == []


def test_a_batch_is_read_once(spark, tmp_path):
    from pathloom.streaming import maintain
    from pathloom.streaming.store import Store

    old = spark.createDataFrame([("s", 100, 5, "a", 16, 100), ("s", 101, 100, "x", 32, 101)], LISTED)
    now = spark.createDataFrame([("s", 100, 5, "a", 16, 100), ("s", 101, 100, "y", 32, 101)], LISTED)
    seen = tmp_path / "seen"
    seen.mkdir()

    def counted(parts, at=str(seen)):
        with open(f"{at}/{uuid.uuid4().hex}", "w"):
            yield from parts

    rows = spark.createDataFrame([("s", 1, None, 101, 100, 0x2000, 32, "y")], maintain.JOURNAL).coalesce(1)
    store = Store(spark, str(tmp_path / "store"))
    maintain.bootstrap(store, old, "s", "j", 0)
    m = maintain.Maintainer(store, lambda: now)
    m(rows.mapInArrow(counted, maintain.JOURNAL), 0)
    assert m.applied == 1 and {(r.object, r.name) for r in store.read().collect()} == {(100, "a"), (101, "y")}
    assert len(os.listdir(seen)) == 1


def test_buffers_go_on_over_arrow_batches(spark):
    rows = spark.range(3000).selectExpr("id AS usn", "id + 10 AS object", "5L AS parent", "256L AS reason", "32 AS attributes", "concat('n', id) AS name")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = usn.encoded(rows.orderBy((rows.usn % 17).desc()), 32).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(r.batch_id for r in got) == list(range(94))
    for r in got:
        assert [(o, at, name.decode("utf-16-le")) for o, _, at, _, _, name, _ in usn.decode(bytes(r.data))] == [
            (at + 10, at, f"n{at}") for at in range(32 * r.batch_id, min(32 * r.batch_id + 32, 3000))
        ]
