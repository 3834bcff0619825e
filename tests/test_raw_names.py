"""Raw names with units that are no text, listing buffers, notices, signatures: against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions.query import folded_bytes, raw_runs, whole_text
from pathloom.operators import index
from pathloom.sources import usn

UNITS = ["a", "Z", ".", "\\", "\ud800", "\udc00", "\U0001d11e", "\ud83d", "é", "￿", "日", "퟿", ""]


def test_runs_of_raw_names_equal_the_plain_fold(spark):
    rng = random.Random(7)
    raws = ["".join(rng.choices(UNITS, k=rng.randrange(0, 12))).encode("utf-16-le", "surrogatepass") for _ in range(400)]
    raws += [b"", b"\x00\xd8" * 255, ("a" * 255).encode("utf-16-le")]
    rows = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(raws)], "id int, raw binary")
    for r in rows.select("id", raw_runs(F.col("raw")).alias("runs"), whole_text(F.col("raw")).alias("text")).collect():
        raw = raws[r.id]
        assert b"\xff".join(run.encode() for run in r.runs) == folded_bytes(raw)
        assert r.text == usn.text(raw)


def test_null_raw_name_has_no_runs(spark):
    row = spark.createDataFrame([(None,)], "raw binary").select(raw_runs(F.col("raw")).alias("runs"), whole_text(F.col("raw")).alias("text")).first()
    assert row.runs is None and row.text is None


def test_listing_buffers_give_their_entries_back(spark):
    entries = [(k, 32 - k % 2 * 16, f"name {k}".encode("utf-16-le")) for k in range(1, 8)]  # no object is 0
    data = usn.encode_listing([(1, 16, ".".encode("utf-16-le")), *entries])
    assert usn.decode_listing(data, 9) == [(i, 9, a, raw) for i, a, raw in entries]
    with pytest.raises(usn.RecordError):
        usn.decode_listing(data[:-8], 9)
    rows = spark.createDataFrame([("d:", 9, bytearray(data)), ("d:", 8, None)], "source string, parent long, data binary")
    assert sorted(r.object for r in usn.listings(rows).collect()) == list(range(1, 8))


def test_notices_of_no_rows(spark):
    none = spark.createDataFrame([], "source string, seq long, at_ms long, action string, path string")
    assert usn.notices(usn.packed_notices(none)).count() == 0


@pytest.mark.parametrize("raw", ["", "ab", "alpha", "alpha beta", "/x alpha", "none of these", "ext:txt alp"])
def test_signatures_never_change_a_search(spark, raw):
    from pathloom.plans import search

    rng = random.Random(3)
    paths = ["/".join(rng.choices(["alpha", "beta", "x", "Alphabet", "b.txt", ""], k=rng.randrange(1, 5))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    found = index.signed_search(index.record_signatures(rows), raw)
    assert sorted(found.collect()) == sorted(search.path_matches(rows, raw).select("id", "path").collect())


def test_scope_learns_directories_in_order(spark):
    from pathloom.operators import journal

    entries = spark.createDataFrame([("d:", 30, 5, "out", 16, 30), ("d:", 40, 5, "a", 16, 40)], "source string, object long, parent long, name string, attributes int, slot long")
    told = [(1, 50, 40, 32), (2, 40, 30, 16), (3, 51, 40, 32), (4, 60, 40, 16), (5, 52, 60, 32), (6, 30, 5, 16)]
    records = spark.createDataFrame([("d:", u, o, p, a) for u, o, p, a in told], "source string, usn long, object long, parent long, attributes int")
    # 40 moves below the excluded 30 at usn 2, 60 below 40 at usn 4
    assert sorted(r.usn for r in journal.in_scope(records, entries, 30).collect()) == [1]
