"""Mountain ranges and the manifest against a plain tree."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, place long, hash string, level string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """(root, siblings before and after of each leaf)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, path in enumerate(paths):
            first = at[k] // fanout * fanout
            path.append(("".join(level[first : at[k]]), "".join(level[at[k] + 1 : first + fanout])))
            at[k] //= fanout
        level = [h(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 3, 16])
@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 27, 64, 81, 100])
def test_a_mountain_range_over_a_whole_tree_ends_at_its_root(n, fanout):
    leaves = [h(str(k)) for k in range(n)]
    mountains = manifest.MountainRange(n, fanout)
    for k, x in enumerate(leaves):
        list(mountains.push(0, k, x))
    assert [p[2] for p in mountains.peaks] == [plain_tree(leaves, fanout)[0]]


@pytest.mark.parametrize("fanout,nodes", [(2, 4096), (2, 4), (2, 2), (3, 9), (5, 5)])
def test_trees_and_paths_equal_a_plain_tree(spark, monkeypatch, fanout, nodes):
    monkeypatch.setattr(manifest, "NODES", nodes)
    sizes = {"": 1, "a": 2, "b": 37, "c": 64, "d": 65, "e": 3}
    leaves = {t: [h(t, str(k)) for k in range(n)] for t, n in sizes.items()}
    rows = [(t, sizes[t], k, x) for t, xs in leaves.items() for k, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "tree string, n long, place long, hash string").repartition(5)
    found, roots, rounds = manifest.trees(df, fanout)
    want = {t: plain_tree(xs, fanout) for t, xs in leaves.items()}
    assert dict(map(tuple, roots.collect())) == {t: w[0] for t, w in want.items()}
    got = {(r.tree, r.place): [tuple(s) for s in r.path] for r in manifest.paths(df, found, rounds, fanout=fanout).collect()}
    assert got == {(t, k): path for t, w in want.items() for k, path in enumerate(w[1])}


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain(rows):
    """What op12 returns, for rows without equal keys and different leaves."""
    def leaf(r, add=0):
        return h(*map(part, (*r[:1], r[1], r[2], r[3] + add if r[3] is not None else None, r[4])))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: plain_tree([leaf(r) for r in g], 2) for x, g in groups.items()}
    root, tops = plain_tree([trees[x][0] for x in langs], 2)
    out = Counter()
    for k, x in enumerate(langs):
        for r, path in zip(groups[x], trees[x][1]):
            path = path + tops[k]
            now = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in path:
                now = h(before, now, after)
            out[r[0], leaf(r), trees[x][0], root, h(*(b + a for b, a in path)), now, now == root] += 1
    return out


def run(docs, tmp_path):
    path = str(tmp_path / "t")
    docs.write.parquet(f"{path}/documents.parquet")
    return Counter(map(tuple, manifest.op12(docs.sparkSession, path).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


@pytest.mark.parametrize("nodes", [4096, 8])
def test_the_manifest_equals_a_plain_version(spark, tmp_path, monkeypatch, nodes):
    monkeypatch.setattr(manifest, "NODES", nodes)
    rows = [(k, f"s{k % 4}", ["en", "de", None, "én"][k % 7 % 4], k * 3, f"text {k} ß") for k in range(300)]
    rows += [(None, None, None, None, None), (900, None, "one", None, ""), (901, "", "", 0, None), (902, "x", "en", 5, "long " * 40_000), (-5, "x", "en", 1, "-")]
    rows += [(7000, "hot", "de", 1, "same")] * 120
    docs = spark.createDataFrame([(*r, "t", 1, "h", "l") for r in rows], SCHEMA).repartition(6)
    got = run(docs, tmp_path)
    assert {k[1] for k in got} == {k[1] for k in plain(rows)}
    assert got == plain(rows)
    assert 0 < sum(v for k, v in got.items() if not k[6]) < len(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, tmp_path, n):
    rows = [(1, "s", "en", 1, "t")][:n]
    assert run(spark.createDataFrame([(*r, "t", 1, "h", "l") for r in rows], SCHEMA), tmp_path) == (plain(rows) if rows else Counter())


def test_a_path_finds_any_change_of_a_row(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, f"t{k}") for k in range(50)], "doc_id long, source string, lang string, n_chars long, text string")
    fields = [F.col(f) for f in manifest.FIELDS]
    told = manifest.manifest(docs, F.struct("doc_id", "text", manifest.leaf([*fields[:4], F.concat("text", F.when(F.col("doc_id") == 9, "!").otherwise(""))]).alias("now")), fields)
    bad = told.where(manifest.folded(F.col("row.now"), F.col("path")) != F.col("root")).select("row.doc_id").collect()
    assert [r.doc_id for r in bad] == [9]
