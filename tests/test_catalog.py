"""Every query against its SQL twin in DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pathloom import catalog


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, tables, duck, name):
    df = catalog.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    at = {c[0]: k for k, c in enumerate(found.description)}
    assert sorted(at) == columns
    want = sorted((tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_pages_by_key_make_up_the_whole(spark, tables):
    from pathloom.plans import search
    from pathloom.sources.fixtures import DOC_PATHS, view

    rows = view(spark, tables, DOC_PATHS)
    seen, after = [], None
    while part := (page := search.next_page(rows, "doc", after, 64)).collect():
        part = [tuple(r) for r in part]
        assert not seen or part[0] > seen[-1]
        seen += part
        after = search.cursor_of(page, "doc")
    assert sorted(r[2] for r in seen) == sorted(r.id for r in search.path_matches(rows, "doc").collect())


def test_pages_lose_no_equal_paths_and_keep_to_one_version(spark):
    from pathloom.plans import search

    rows = spark.createDataFrame([(k, "same/path") for k in range(5)], "id long, path string")
    seen, after = [], None
    while part := (page := search.next_page(rows, "same", after, 2, version=3)).collect():
        seen += [r.id for r in part]
        after = search.cursor_of(page, "same", version=3)
    assert seen == [0, 1, 2, 3, 4]
    for raw, version in (("same", 4), ("path", 3)):
        with pytest.raises(ValueError, match="another"):
            search.next_page(rows, raw, search.Cursor(3, "same", "A", 0, "x", 1), 2, version=version)
