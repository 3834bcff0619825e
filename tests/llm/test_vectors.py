"""Vector operators against brute force, with hot copies, nulls, zeros and mixed dimensions."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import metricjoin, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n string, cid string, dim string"


def table(spark, seed=1, many=260):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 16))
    rows = []
    for k in range(many):
        v = centres[k % 9] + rng.normal(size=16) * (0.08 if k % 4 else 1.5)
        v *= rng.uniform(0.2, 3)
        rows.append((k, [float(x) for x in v.astype(np.float32)], k % 3))
    rows += [(1000 + k, [1.0] * 16, 1) for k in range(60)]
    rows += [
        (2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [float("inf")] * 16, 1),
        (2100, [], 1), (2120, [1.0] * 3, 1), (2140, [1.0] * 3, 1), (2160, [1.0] * 16, None), (None, [1.0] * 16, 1), (1000, [1.0] * 16, 1),
    ]
    rows = [(*r, "a", "b", "c") for r in rows]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("cell,block", [(4096, 2048), (20, 8)])
def test_metric_join_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(metricjoin, "CELL", cell)
    monkeypatch.setattr(metricjoin, "BLOCK", block)
    rows, df = table(spark)
    use = [r for r in rows if r[0] is not None and r[2] is not None and fine(r[1]) and any(r[1])]
    links, group = Counter(), {r[0]: r[0] for r in rows}

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(use)):
        for b in range(len(use)):
            x, y = np.array(use[a][1], float), np.array(use[b][1], float)
            if a != b and use[a][2] == use[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                p, q = find(use[a][0]), find(use[b][0])
                group[max(p, q)] = min(p, q)
    want = Counter((r[0], links[k], find(r[0]), r[0] == find(r[0])) for k, r in enumerate(use))
    want += Counter((r[0], 0, find(r[0]), True) for r in rows if r not in use)
    assert Counter(map(tuple, metricjoin.near_duplicates(df).collect())) == want
    assert metricjoin.near_duplicates(df.limit(0)).count() == 0


def plain_top(rows, k=20):
    """Every row is a candidate and, if its vec_id is divisible by 20, a query; scores in Python's integers."""
    found = [(r[0], [math.floor(64 * Fraction(x)) for x in r[1]]) for r in rows if r[0] is not None and fine(r[1])]
    clamp = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    found = [(i, [clamp(x) for x in v]) for i, v in found]
    out = Counter()
    for at, (q, x) in enumerate(found):
        if q % 20 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(x, y))), i) for k_, (i, y) in enumerate(found) if k_ != at and len(x) == len(y))[:k]
            out.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    return out


SIZES = ("SEEDS", "BLOCK", "CHUNK", "STEPS", "BUCKET", "COSINE")


@pytest.mark.parametrize("sizes", [(4096, 4096, 16384, 64, 512, 0.6), (30, 4, 50, 3, 16, 0.1), (30, 4, 50, 5, 16, 0.99)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(SIZES, sizes):
        monkeypatch.setattr(topk, name, value)
    rows, df = table(spark, 2)
    assert Counter(tuple(r) for r in topk.top_k(df).collect()) == plain_top(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.25, 0.0]), (0, [2.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(tuple(r) for r in topk.top_k(df).collect())
    assert got == plain_top(rows) and sum(got.values()) == 8


@pytest.mark.parametrize("scale", [1e6, 3e7, 1e9, 1e30])
def test_large_components_have_exact_products(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(20 * k, [float(x) for x in rng.normal(size=5) * scale]) for k in range(40)] + [(7, [0.0] * 5), (8, [3.3e38] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(tuple(r) for r in topk.top_k(df).collect()) == plain_top(rows)


def test_tiles_of_queries_stay_small(spark, monkeypatch):
    """All ids are divisible by 20: no tile gets more than about its share of queries or of vectors."""
    for name, value in zip(SIZES, (64, 32, 64, 4, 16, 0.6)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    most, plain = [], topk.tiles
    for n in (400, 1600):
        rows = [(20 * k, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(n)]
        held = []

        def counted(v, queries):
            asked, placed = plain(v, queries)
            held.extend(x.groupBy("dim", "class", "block", "chunk").count().agg(F.max("count")).first()[0] for x in (asked, placed))
            return asked, placed

        monkeypatch.setattr(topk, "tiles", counted)
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
        assert n > 400 or Counter(tuple(r) for r in got.collect()) == plain_top(rows)
        most.append(held)
    assert all(b < 1.6 * a and b < 130 for a, b in zip(*most))


def test_large_doubles_link_by_their_angle(spark):
    rows = [(1, [1e39, 1.0], 1), (2, [1e39, 2.0], 1), (3, [1e-300, 1e-300], 1), (4, [3e-300, 3e-300], 1), (5, [0.0, 1e308], 1), (6, [1e39, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in metricjoin.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_largest_tile_does_not_grow_with_the_label(spark, monkeypatch):
    monkeypatch.setattr(metricjoin, "BLOCK", 64)
    most = []
    for n in (500, 4000):
        members = spark.range(n).selectExpr("1L AS grp", "0 AS cell", "id AS cid", "array(1.0D, double(id)) AS embedding", "1L AS mult", "id % 2 = 0 AS native")
        most.append(metricjoin.tiled(members).groupBy("grp", "cell", "block", "tile").count().agg(F.max("count")).first()[0])
    assert most[1] < 1.5 * most[0] and most[1] < 4 * 64
