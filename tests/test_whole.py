"""Queries over all of their rows, where the SQL twin in the catalog holds only some of them."""

import glob
import os

import duckdb
import pytest

from pathloom import catalog
from test_catalog import plain


def rows_of_sql(folder, text):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(text)
    names = [c[0] for c in found.description]
    return sorted((tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall()), key=repr)


def rows_of_query(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    return sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def same(spark, folder, name):
    got = rows_of_query(spark, folder, name)
    assert got == rows_of_sql(folder, catalog.ORACLES[name])
    return got


def test_dependent_renames_against_pairs(spark):
    from pathloom.operators import inventory

    paths = ["a", "a/b", "a/b/c", "ab", "a/d", "m/x", "m/y", "m/x/z"]
    changes = [(k, "rename", None, paths[k * 5 % 8], f"m/{'xyz'[k % 3]}") if k % 2 else (k, "remove", paths[k * 3 % 8], None, None) for k in range(40)]
    df = spark.createDataFrame(changes, "seq long, kind string, path string, source string, target string")
    live = spark.createDataFrame([("m/x", "directory"), ("m/y", "file"), ("m/z", "directory")], "path string, kind string")

    def meet(p, q):
        return p == q or p.startswith(f"{q}/") or q.startswith(f"{p}/")

    want = [
        c[0] for c in changes
        if c[1] == "rename" and c[4] in ("m/x", "m/z") and any(e[0] < c[0] and any(meet(c[3], p) for p in e[2:] if p) for e in changes)
    ]
    assert sorted(r.seq for r in inventory.dependent_renames(df, live).collect()) == want and 0 < len(want)


def test_nearest_known_of_all_customers(spark):
    got = same(spark, "/root/testdata/sf0.01", "nearest_known")  # the smallest tables with more than 201 customers
    assert max(r[1] for r in got) > 1000200


@pytest.fixture(scope="module")
def late(spark, tables, tmp_path_factory):
    """The smallest tables with a journal that names users 3 and 4 only from usn 400 on."""
    folder = tmp_path_factory.mktemp("late")
    for f in glob.glob(f"{tables}/*.parquet"):
        if not f.endswith("/events.parquet"):
            os.symlink(f, folder / os.path.basename(f))
    duckdb.connect().execute(
        f"COPY (SELECT * REPLACE (CAST(CASE WHEN event_id < 400 THEN 1 ELSE 3 + event_id % 2 END AS BIGINT) AS user_id) FROM '{tables}/events.parquet') "
        f"TO '{folder}/events.parquet' (FORMAT parquet)"
    )
    return str(folder)


@pytest.mark.parametrize("name", ["dirty_parents", "replace_children", "unchanged_parents", "apply_journal", "stream_apply"])
def test_records_after_the_window_count(spark, late, name):
    same(spark, late, name)


def test_neighbours_and_ranks_against_plain_lists(spark):
    import math
    import random

    from pathloom.operators.ranks import adjacent_repeats, nearest_ranks, neighbours

    rng = random.Random(3)
    rows = [(rng.choice("ab"), k * rng.randint(1, 3) + 1000 * k, float(rng.choice([1, 1, 2, 3, 5, 8.5])) if rng.random() < 0.9 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, seq long, v double")
    for size in (3, 1 << 16):
        got = {r.seq: (r.before and r.before.v, r.after and r.after.seq) for r in neighbours(df, "g", "seq", ["v", "seq"], size).collect()}
        for g in "ab":
            own = sorted(r for r in rows if r[0] == g)
            own.sort(key=lambda r: r[1])
            for k, r in enumerate(own):
                assert got[r[1]] == (own[k - 1][2] if k else None, own[k + 1][1] if k + 1 < len(own) else None)
    for cuts in (4, 64):
        got = {r.g: (r.low, r.mid, r.top) for r in nearest_ranks(df, "g", "v", {"low": 0.0, "mid": 0.5, "top": 1.0}, cuts).collect()}
        for g in "ab":
            own = sorted(r[2] for r in rows if r[0] == g and r[2] is not None)
            assert got[g] == tuple(own[math.ceil((len(own) - 1) * s)] for s in (0.0, 0.5, 1.0))
    assert neighbours(df.limit(0), "g", "seq", ["v"]).count() == nearest_ranks(df.limit(0), "g", "v", {"x": 0.5}).count() == 0
    again = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x")], "g string, o long, n string")
    assert sorted(r.o for r in adjacent_repeats(again, ["g"], "n", ["o"]).collect()) == [2, 2]


def test_notices_from_bytes_to_renames(spark):
    from pathloom.operators import journal
    from pathloom.sources import usn

    buffers = [("s", 0, 10, usn.encode_notices([(4, "old.txt"), (5, "näw.txt"), (2, "gone"), (4, "lost")])), ("s", 4, 500, usn.encode_notices([(5, "late")])), ("t", 0, 0, None)]
    df = spark.createDataFrame([(s, f, a, b and bytearray(b)) for s, f, a, b in buffers], "source string, first long, at_ms long, data binary")
    got = sorted((r.seq, r.kind, r.path, r.source_path) for r in journal.rename_pairs(usn.notices(df)).collect())
    assert got == [(1, "rename", "näw.txt", "old.txt"), (2, "remove", "gone", None), (3, "loss", "lost", None), (4, "loss", "late", None)]


def test_shards_with_repeated_rows(spark, tables):
    from collections import Counter

    from pyspark.sql import functions as F

    from pathloom.functions.names import shard_of
    from pathloom.sources import fixtures
    from pathloom.streaming.store import changed_shards

    def shards(old, new):
        a, b = (Counter(tuple(r) for r in x.select("path", "kind", shard_of(F.col("path"), 64)).collect()) for x in (old, new))
        return {r[2] for r in (a - b) + (b - a)}

    def found(old, new):
        got = [r.shard for r in changed_shards(old, new).collect()]
        assert len(got) == len(set(got))
        return set(got)

    one = spark.createDataFrame([("p", "file"), ("q", "file")], "path string, kind string")
    two, p = one.unionByName(one), one.where("path = 'p'")
    assert found(one, one.unionByName(p).unionByName(p)) == shards(one, one.unionByName(p).unionByName(p)) != set()
    assert found(one.limit(0), two) == found(two, one.limit(0)) == shards(one.limit(0), two) and found(two, two) == set()
    old, new = fixtures.view(spark, tables, fixtures.INV_OLD), fixtures.view(spark, tables, fixtures.INV_NEW)
    assert found(old, new) == shards(old, new) != set()
