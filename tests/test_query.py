"""Dialects against a plain matcher, folding of raw names, categories and name rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions import names
from pathloom.functions.query import entry_predicate, folded_bytes, parse, path_predicate

PARTS = ["a", "B", "é", "ß", "Σ", "İ", "ı", "K", "漢", "字", "_", "%", " ", ".", "ab", "txt", "\\", "report"]
name = st.lists(st.sampled_from(PARTS), min_size=1, max_size=5).map("".join)
word = st.lists(st.sampled_from([*PARTS, "/", "ext:", "ext:TXT"]), min_size=0, max_size=4).map("".join)
query = st.lists(word, max_size=3).map(" ".join)


def plain_a(raw, path):
    q = parse(raw, "A")
    low = path.lower()
    base = low.rsplit("/", 1)[-1]
    whole = low if "/" in low else "/" + low
    return all(t in whole for t in q.tokens) and (q.ext is None or ("." in base and base.rsplit(".", 1)[1] == q.ext))


def plain_b(raw, entry, parent):
    q = parse(raw, "B")
    n, p = entry.replace("\\", "/").lower(), parent.lower()
    ok = all(t in n or t in p or ("/" in t and t in f"{p}/{n}") for t in q.tokens)
    return ok and (q.ext is None or ("." in n and n.rsplit(".", 1)[1] == q.ext))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(name, name), min_size=1, max_size=12), query)
def test_dialects_equal_plain_matchers(spark, rows, raw):
    df = spark.createDataFrame([(n, f"d:/{p}", f"{p}/{n}" if len(p) % 2 else n) for n, p in rows], "name string, parent string, path string")
    folded = F.lower(F.translate("name", "\\", "/"))
    got = df.select(
        entry_predicate(parse(raw, "B"), folded, F.lower("parent")).alias("b"),
        path_predicate(parse(raw, "A"), F.col("path")).alias("a"),
        path_predicate(parse(raw, "C"), F.col("path")).alias("c"),
        "name", "parent", "path",
    ).collect()
    for r in got:
        assert r.b == plain_b(raw, r["name"], r.parent)
        assert r.a == plain_a(raw, r.path)
        assert r.c == (raw in r.path)


def test_parsing():
    q = parse("  Foo\\Bar　ext:TXT\x85ext:Md ", "B")
    assert q.tokens == ("foo/bar",) and q.ext == "md"
    assert parse("Foo\\Bar EXT:x", "A").tokens == ("foo\\bar", "ext:x")
    assert parse("", "B").tokens == () and parse(" a", "C").tokens == (" a",)
    for raw, dialect in (("x" * 513, "A"), ("x" * 4097, "B"), ("x" * 513, "C")):
        with pytest.raises(ValueError):
            parse(raw, dialect)


def test_raw_names_fold_around_broken_units():
    raw = "Ab".encode("utf-16-le") + b"\x00\xd8" + "C\\D".encode("utf-16-le")
    assert folded_bytes(raw) == b"ab\xffc/d"
    assert folded_bytes("😀Σ".encode("utf-16-le")) == "😀σ".encode()


def test_names(spark):
    rows = [("a.b.TXT", "TXT"), ("noext", None), ("dot.", ""), (".x", "x")]
    df = spark.createDataFrame(rows, "name string, want string")
    assert df.where(~names.extension(F.col("name")).eqNullSafe(F.col("want"))).count() == 0
    ok = {"a": True, "": False, ".": False, "..": False, "a/b": False, "a:b": False, "a\\b": False, "a\0b": False, "é" * 255: True, "é" * 256: False, "😀" * 128: False}
    got = spark.createDataFrame([(k,) for k in ok], "name string").select("name", names.valid_name(F.col("name"))).collect()
    assert dict(map(tuple, got)) == ok
    paths = {"a/b": True, "/a": False, "a//b": False, "a/.": False, "../a": False, "": False, "a:b": False, "c/d\0": False, "a" * 4096: True, "a" * 4097: False}
    got = spark.createDataFrame([(k,) for k in paths], "p string").select("p", names.valid_change_path(F.col("p"))).collect()
    assert dict(map(tuple, got)) == paths
    with pytest.raises(ValueError):
        names.of_category("pictures", F.col("a"), F.col("n"))


def test_retained_cursor(spark):
    df = spark.createDataFrame([("j", "j", c) for c in (4, 5, 9, 10, 11)] + [("j", "k", 7)], "a string, b string, c long")
    kept = names.retained("a", F.lit(3), F.lit(5), F.lit(10), "b", F.col("c"))
    assert [r[0] for r in df.select(kept).collect()] == [False, True, True, True, False, False]
