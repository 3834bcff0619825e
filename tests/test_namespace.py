"""Graphs and journals on small namespaces: links, faults, pruning, replay against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import inventory, journal, namespace
from pathloom.operators.components import components
from pathloom.operators.index import indexed_search, postings, signatures
from pathloom.plans import search
from pathloom.sources import listing

ENTRY = "source string, object long, parent long, name string, attributes int, slot long"
RECORD = "source string, usn long, object long, parent long, reason long, attributes int, name string"
D, F_, R = 16, 32, 16 | 1024


def table(spark, rows):
    return spark.createDataFrame([("d:", *r, 1000 + k) for k, r in enumerate(rows)], ENTRY)


TREE = [(100, 5, "Docs", D), (101, 100, "Inner", D), (200, 101, "a.TXT", F_), (201, 5, "root.png", F_), (200, 5, "link.txt", F_), (102, 5, "junction", R), (300, 999, "lost.txt", F_)]


def test_paths_links_and_reparse_points(spark):
    t = table(spark, TREE)
    got = {(r.object, r.path) for r in namespace.paths(t).collect()}
    assert got == {(100, "d:/Docs"), (101, "d:/Docs/Inner"), (200, "d:/Docs/Inner/a.TXT"), (201, "d:/root.png"), (200, "d:/link.txt"), (102, "d:/junction")}
    assert [r.object for r in namespace.unreachable(t).collect()] == [300]
    assert {tuple(r.parents) for r in namespace.alias_parents(t).where("object = 200").collect()} == {(5, 101)}


@pytest.mark.parametrize("depth", [1, 2, 3, 7, 40])
def test_depth_limit_and_cycles(spark, depth):
    chain = [(100 + k, 5 if k == 0 else 99 + k, f"n{k}", D) for k in range(40)] + [(900, 901, "x", D), (901, 900, "y", D)]
    got = namespace.directories(table(spark, chain), most=depth).where("depth > 0").collect()
    assert sorted(r.depth for r in got) == list(range(1, depth + 1))
    assert max(r.path.count("/") for r in got) == depth


def test_search_fails_on_an_unresolvable_match_only(spark):
    t = table(spark, TREE)
    with pytest.raises(Exception, match="can't be resolved"):
        search.matches(t, "lost").collect()
    good = t.where("object <> 300")
    assert {r.path for r in search.matches(good, "docs txt").collect()} == {"d:/Docs/Inner/a.TXT"}
    assert {r.path for r in search.matches(good, "inner/A.txt").collect()} == {"d:/Docs/Inner/a.TXT"}
    p = search.page(good, "", 2)
    assert (p.total, p.exact) == (3, False) and p.rows.count() == 2
    p = search.page(good, "", 6)
    assert (p.total, p.exact) == (6, True)
    p = search.page(good, "", 3, valid=~F.col("name").startswith("root"))
    assert [r.object for r in p.rows.orderBy("slot").collect()] == [100, 101, 200] and (p.total, p.exact, p.skipped) == (4, False, 0)


def test_violations(spark):
    t = table(spark, [(100, 5, "a", D), (100, 5, "b", D), (200, 5, "c", F_), (201, 5, "c", F_), (202, 777, "d", F_), (203, 5, "..", F_)])
    assert {r["check"]: r.n for r in namespace.violations(t).collect()} == {"bad_row": 1, "repeated_name": 1, "directory_names": 1, "unreachable": 1, "long_path": 0}


def test_prune_keeps_outside_links(spark):
    t = table(spark, [(100, 5, "top", D), (101, 100, "in", D), (200, 101, "f", F_), (200, 5, "out", F_)])
    gone = t.where("object = 100").select("source", "object")
    assert [(r.object, r.name) for r in namespace.pruned(t, gone).collect()] == [(200, "out")]


def plain_scope(records, entries, top):
    """The sequential rule: a directory that is, or is told to be, below the excluded one gets the parent told."""
    up = {o: p for o, p, _, a in entries if a == D}
    moved, out = {}, []

    def inside(o):
        for _ in range(64):
            if o == top:
                return True
            if o == 5:
                return False
            o = moved.get(o, up.get(o))
            if o is None:
                return False
        return False

    for usn, o, p, a in records:
        below = inside(p)
        if a == D and (below or inside(o)):
            moved[o] = p
        if o == top or below:
            continue
        out.append(usn)
    return out


@pytest.mark.parametrize("seed", (1, 3))
def test_excluded_scope_follows_the_records_in_order(spark, seed):
    rng = random.Random(seed)
    entries = [(100, 5, "store", D), (101, 100, "s1", D), (102, 5, "free", D), (110, 102, "a", D), (111, 101, "b", D), (120, 110, "still", D)]
    objects, parents = [110, 111, 112, 113, 101, 200, 100], [5, 100, 101, 102, 110, 111, 112, 113, 120]
    records = [(u, rng.choice(objects), rng.choice(parents)) for u in range(50)]
    records = [(u, o, p, F_ if o == 200 else D) for u, o, p in records if o != p]
    df = spark.createDataFrame([("d:", u, o, p, 256, a, "n") for u, o, p, a in records], RECORD)
    got = [r.usn for r in journal.in_scope(df, table(spark, entries), 100).orderBy("usn").collect()]
    assert got == plain_scope(records, entries, 100)


def test_a_directory_leaves_the_excluded_scope(spark):
    entries = table(spark, [(100, 5, "store", D), (101, 100, "in", D), (102, 5, "out", D)])
    records = [(1, 200, 101, F_), (2, 101, 102, D), (3, 201, 101, F_), (4, 101, 100, D), (5, 202, 101, F_)]
    df = spark.createDataFrame([("d:", u, o, p, 256, a, "n") for u, o, p, a in records], RECORD)
    assert sorted(r.usn for r in journal.in_scope(df, entries, 100).collect()) == [2, 3]


def test_scope_of_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 1,000 directories, each told to be below the one before it."""
    entries = table(spark, [(100, 5, "store", D), (102, 5, "free", D)])
    records = [(k, 1000 + k, 999 + k if k else 100, D) for k in range(1000)] + [(2000, 7000, 1999, F_), (2001, 7001, 102, F_)]
    df = spark.createDataFrame([("d:", u, o, p, 256, a, "n") for u, o, p, a in records], RECORD)
    rounds, written = [], journal.written
    monkeypatch.setattr(journal, "written", lambda rows, name: rounds.append(name) or written(rows, name))
    assert [r.usn for r in journal.in_scope(df, entries, 100).collect()] == [2001]
    assert len(rounds) < 40


def test_apply_follows_renames_moves_and_deletes(spark):
    old = table(spark, [(100, 5, "a", D), (101, 100, "sub", D), (200, 101, "f.txt", F_), (201, 100, "g.txt", F_), (102, 5, "b", D), (201, 102, "g2.txt", F_)])
    now = table(spark, [(101, 102, "moved", D), (200, 101, "f.txt", F_), (102, 5, "b", D), (201, 102, "g2.txt", F_), (103, 102, "new", D), (104, 103, "deep", D), (205, 104, "x", F_)])
    records = spark.createDataFrame(
        [("d:", 1, 101, 102, 0x2000, D, "moved"), ("d:", 2, 103, 102, 0x100, D, "new"), ("d:", 3, 100, 5, 0x200, D, "a"), ("d:", 4, 201, 100, 0x200, F_, "g.txt"), ("d:", 5, 7, 5, 0x100, F_, "internal")],
        RECORD,
    )
    got = {(r.object, r.parent, r.name) for r in journal.applied(old, records, now).collect()}
    assert got == {(r.object, r.parent, r.name) for r in now.collect()}
    same = journal.applied(old, records.where("usn > 9"), now)
    assert same is old
    with pytest.raises(journal.ReconcileError):
        journal.applied(old, spark.createDataFrame([("d:", 1, 300, 555, 0x100, F_, "n")], RECORD), now)
    with pytest.raises(journal.ReplayBudgetError):
        journal.replay(records, 0, 10, budget=100)


def test_inventory_changes(spark):
    inv = spark.createDataFrame([("a", "directory"), ("a/x", "file"), ("ab", "file"), ("b", "directory"), ("b/y", "file")], "path string, kind string")
    assert {r.path for r in inventory.renamed(inv, "a", "b").collect()} == {"b", "b/x", "ab"}
    assert {r.path for r in inventory.removed(inv, "a").collect()} == {"ab", "b", "b/y"}
    with pytest.raises(ValueError):
        inventory.renamed(inv, "a", "a/x")
    assert inventory.within(inv) and not inventory.within(inv, entries=4) and not inventory.within(inv, dirs=2)
    now = spark.createDataFrame([("a", "directory"), ("a/z", "file"), ("b", "directory")], "path string, kind string")
    tops = spark.createDataFrame([("a",)], "path string")
    assert {r.path for r in inventory.refreshed(inv, now, tops).collect()} == {"a", "a/z", "ab", "b", "b/y"}
    assert inventory.missing_ancestors(inv.where("path <> 'a'")).collect()[0].path == "a"


@pytest.mark.parametrize("raw", ["report_00000010", "报告", "报", "9.md", "a", "ext:md readme", "workspace_000/src", "no such thing", "", "ab_n ext:md"])
def test_index_equals_scan(spark, raw):
    rows = listing.synthetic(spark, 700).cache()
    got = indexed_search(rows, postings(rows), signatures(rows), raw)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in search.path_matches(rows, raw).collect()}


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (None, 4), (7000, 7001), (7001, 7000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)} | {7000: 7000, 7001: 7000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def deep(spark, depth, below, at):
    """A chain of directories, and a subtree of `below` more that hangs at directory number `at` of the chain (0: the root)."""
    chain = [(100 + k, 99 + k if k else 5, f"c{k}", D) for k in range(depth)]
    tree = [(5000 + k, 4999 + k if k else (99 + at if at else 5), f"t{k}", D) for k in range(below)] + [(9000, 4999 + below, "leaf.txt", F_)]
    return table(spark, chain + tree)


@pytest.mark.parametrize("at,fine", [(1004, True), (1005, False)])
def test_a_move_that_pushes_what_is_below_it_too_deep_is_refused(spark, at, fine):
    import time

    old, new = deep(spark, 1024, 20, 0), deep(spark, 1024, 20, at)
    touched = spark.createDataFrame([("d:", 5), ("d:", 99 + at)], "source string, parent long")
    known = namespace.written(namespace.directories(old), "known")
    began = time.perf_counter()
    quick = {r["check"]: r.n for r in namespace.violations_at(new, touched, old=old, known=known).collect()}
    assert time.perf_counter() - began < 60
    whole = {r["check"]: r.n for r in namespace.violations_at(new, touched).collect()}
    assert (quick["unreachable"] == 0) == (whole["unreachable"] == 0) == fine
    assert quick["long_path"] == whole["long_path"] == quick["bad_row"] == 0


def test_a_move_that_makes_a_path_too_long_is_refused(spark):
    rows = [(100 + k, 99 + k if k else 5, f"{k:03d}" + "x" * 247, D) for k in range(130)]
    tail = lambda p: [(7000, p, "y" * 200, D), (7001, 7000, "z" * 200 + "é", F_)]
    old, near, far = (table(spark, rows + tail(p)) for p in (5, 100 + 100, 100 + 129))
    known = namespace.written(namespace.directories(old), "known")
    for new, n in ((near, 0), (far, 2)):
        touched = spark.createDataFrame([("d:", 5), ("d:", 200), ("d:", 229)], "source string, parent long")
        got = {r["check"]: r.n for r in namespace.violations_at(new, touched, old=old, known=known).collect()}
        whole = {r["check"]: r.n for r in namespace.violations(new).collect()}
        assert got["long_path"] == whole["long_path"] == n and got["unreachable"] == 0


def test_refreshed_paths_stream_entries_past_directories(spark, monkeypatch):
    from pathloom import session

    def chain(name):
        tops = [(100 + k, 5, f"top{k}", D) for k in range(3)] + [(110, 100, name, D), (110, 101, "again", D), (111, 110, "in", D), (120, 999, "lost", D)]
        return table(spark, tops + [(200 + k, 100, f"hot{k}", D) for k in range(150)] + [(500 + k, (110, 111, 102, 120, 200 + k)[k % 5], f"f{k}.txt", F_) for k in range(150)])

    def merged(df):
        return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")

    old, new = (namespace.written(chain(n), "version") for n in ("old", "new"))
    changed = spark.createDataFrame([("d:", 100)], "source string, object long")
    columns = ["source", "object", "parent", "name", "path", "is_directory"]
    monkeypatch.setattr(session, "HELD_BYTES", 0, raising=False)
    monkeypatch.setattr(namespace, "written", lambda df, name: seen.append((name, merged(df))) or session.written(df, name))
    before, seen = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = namespace.refreshed_paths(namespace.paths(old).select(*columns), old, new, changed)
        assert merged(got) == 0 and sum(name == "below" for name, _ in seen) > 1 and not any(n for name, n in seen if name == "climb")
        want = namespace.paths(new).select(*columns)
        rows = sorted(map(tuple, got.select(*columns).collect()))
        assert rows == sorted(map(tuple, want.collect())) and len(rows) == 3 + 2 + 2 + 150 + 60 + 60 + 30 + 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
