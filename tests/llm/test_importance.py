"""The ring of CRC states and the draw against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import importance

SCHEMA = "doc_id long, text string, row string, n string, words int, rank string, score string"


def plain_buckets(text, runs, buckets):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [" ".join(words[k - n : k]) for k in range(1, len(words) + 1) for n in range(1, runs + 1) if k >= n]
    return len(words), [zlib.crc32(f.encode()) % buckets for f in found]


@pytest.mark.parametrize("runs,buckets", [(1, 10), (2, 10_000), (3, 70_000)])
def test_emitted_buckets_are_those_of_all_runs(monkeypatch, runs, buckets):
    monkeypatch.setattr(importance, "BLOCK", 4)
    for text in ("", " ", "One", "A b c A b", "é`ß-0x{ÄÖ}  Z\nZ", "tab\tx\x00y\x7fz", "word " * 500, "日本 語テスト", "\U0001d11e a"):
        n, packed = importance.emitted(text.encode(), runs, buckets)
        words, want = plain_buckets(text, runs, buckets)
        assert n == words and Counter(importance.unpacked(packed, buckets).tolist()) == Counter(want)


def plain(rows, target, runs=2, buckets=10_000, seed=7, percent=25, least=20):
    scans = [plain_buckets(r[1], runs, buckets) for r in rows]
    s, t = Counter(), Counter()
    for _, found in scans:
        s.update(found)
    for text in target:
        t.update(plain_buckets(text, runs, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for r, (n, found) in zip(rows, scans):
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    n = percent * len(fit) // 100
    return Counter((*x[:4], k + 1 if k < n else None) for k, x in enumerate(fit)) + Counter((*x[:4], None) for x in out if not x[4])


def table(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["Äpfel", "übung", "日本"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(1, 90)))) for k in range(150)]
    rows += [(500, rows[3][1])] * 80 + [(None, rows[4][1])] * 3 + [(None, None), (501, None), (502, ""), (503, "?!"), (504, "long " * 30_000), (505, "x" * 100_000), (7, "again " * 25)]
    return rows, spark.createDataFrame([(*r, "a", "b", 1, "c", "d") for r in rows], SCHEMA).repartition(7)


@pytest.mark.parametrize("settings", [{}, {"runs": 3, "buckets": 70_000, "percent": 60, "least": 0}, {"runs": 1, "buckets": 11, "percent": 0}])
def test_the_draw_equals_a_plain_version(spark, settings):
    rows, docs = table(spark)
    aims = ["w1 w2 w3 w4", None, "", rows[9][1]]
    target = spark.createDataFrame([(1, x) for x in aims], "item_id long, text string")
    got = importance.resampled(docs, target, F.struct("doc_id"), **settings).select("row.doc_id", "n_features", "weight", "score", "rank")
    assert Counter(map(tuple, got.collect())) == plain(rows, aims, **settings)


def test_drawn_rows_keep_their_columns_and_empty_tables_work(spark):
    rows, docs = table(spark)
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    out = importance.drawn(docs, target)
    assert out.columns == docs.columns and out.count() == sum(len(re.findall(r"[^\x00-/:-`{-\x7f]+", (r[1] or "").lower())) >= 20 for r in rows) // 4
    assert importance.resampled(docs.limit(0), target, F.struct("doc_id")).count() == 0
    some = importance.resampled(docs.where("doc_id < 40"), target.limit(0), F.struct("doc_id"))
    assert Counter((r.row.doc_id, r.weight, r.rank) for r in some.collect()) == Counter({(k[0], k[2], k[4]): v for k, v in plain([r for r in rows if r[0] is not None and r[0] < 40], []).items()})
