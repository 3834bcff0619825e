"""Scans under budgets, and listings that are refused."""

import pytest

from pathloom.sources import scan
from test_namespace import D, F_, R, table

TREE = [(100, 5, "a", D), (101, 100, "target", D), (102, 100, "b", D), (103, 102, "c", D), (200, 5, "target", F_), (201, 101, "x", F_), (202, 102, "y", F_), (203, 103, "z", F_), (104, 5, "link", R), (204, 104, "beyond", F_)]


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame([("d:", 5)], "source string, object long")


def names(found):
    return [r.path for r in found.rows.orderBy("level", "path").collect()]


def test_a_scan_without_pressure_is_complete(spark, roots):
    found = scan.scanned(scan.listed_from(table(spark, TREE)), roots)
    assert names(found) == ["a", "target", "a/b", "a/b/c", "a/b/y", "a/b/c/z"]  # no link, no excluded directory; a file may have its name
    assert found.complete and (found.examined, found.directories) == (8, 4)


@pytest.mark.parametrize(
    "limits,reason,paths",
    [
        (scan.Limits(entries=4), "entries", ["a", "target", "a/b"]),
        (scan.Limits(entries=0), "entries", []),
        (scan.Limits(directories=2), "directories", ["a", "target", "a/b"]),
        (scan.Limits(depth=1), "depth", ["a", "target", "a/b"]),
    ],
)
def test_a_used_up_budget_is_told(spark, roots, limits, reason, paths):
    found = scan.scanned(scan.listed_from(table(spark, TREE)), roots, limits)
    assert not found.complete and found.reason == reason and names(found) == paths


def test_nothing_and_cycles_end(spark, roots):
    assert names(scan.scanned(scan.listed_from(table(spark, TREE)), roots.limit(0))) == []
    ring = table(spark, [(100, 5, "a", D), (101, 100, "b", D), (100, 101, "a", D)])
    assert scan.scanned(scan.listed_from(ring), roots, scan.Limits(depth=6)).reason == "depth"


def test_listings_are_refused_for_the_first_fault(spark):
    before = table(spark, [(100, 5, "a", D), (101, 5, "b", D), (102, 5, "c", D), (103, 5, "d", D)])
    after = table(spark, [(100, 5, "a", D), (101, 5, "other", D), (102, 5, "c", D), (103, 5, "d", D)])
    now = table(spark, [(200, 100, "x", F_), (201, 101, "x", F_), (202, 101, "x", F_), (203, 102, "x", F_), (204, 102, "x", F_), (205, 103, "long" * 60, F_)])
    asked = [scan.directory_tags(after), scan.directory_tags(before)]
    dirs = spark.createDataFrame([("d:", k) for k in (100, 101, 102, 103, 999)], "source string, object long")
    rows, refused = scan.verified(scan.listed_from(now), dirs, lambda some: asked.pop()(some), 400)
    assert [r.object for r in rows.collect()] == [200]
    assert {r.parent: r.reason for r in refused.collect()} == {101: "identity", 999: "identity", 102: "repeated_name", 103: "budget"}


def test_scans_without_a_budget_of_directories_list_any_number(spark, roots):
    """More directories than the default budget has: only entries bound this scan."""
    n = scan.Limits().directories + 10
    wide = spark.range(n).selectExpr("'d:' AS source", "id + 1000 AS object", "5L AS parent", "concat('d', id) AS name", f"{D} AS attributes")
    files = spark.range(20).selectExpr("'d:' AS source", "id + 9000000 AS object", f"{n} + 999 AS parent", "concat('f', id) AS name", f"{F_} AS attributes")
    tree = wide.unionByName(files)
    cut = scan.scanned(scan.listed_from(tree), roots, scan.Limits(entries=n + 15, directories=None))
    assert (cut.reason, cut.examined, cut.directories) == ("entries", n + 15, n + 1)
    whole = scan.scanned(scan.listed_from(tree), roots, scan.Limits(entries=None, directories=None))
    assert whole.complete and whole.rows.count() == n + 20
