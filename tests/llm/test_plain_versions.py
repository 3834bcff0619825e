"""Quality and shards against plain Python versions of the same method."""

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from pathloom.llm import quality, sharding

# quality


def plain_features(text):
    data = (text or "").encode()
    marks = [9, 10] + [b for b in range(32, 127) if not chr(b).isalnum()]
    if not data:
        return np.zeros(len(marks) + 12)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    sizes = [len(w) for w in words] or [0]
    share = lambda f: sum(map(f, data)) / len(data)
    out = [(data.count(bytes([m])) / len(data)) ** 0.5 for m in marks]
    out += [np.log1p(len(data)), share(lambda b: 65 <= b < 91), share(lambda b: 48 <= b < 58), share(lambda b: 97 <= b < 123), share(lambda b: b > 127)]
    out += [np.mean(sizes), np.std(sizes), len(set(words)) / max(1, len(words)), sum(w.isupper() for w in words) / max(1, len(words))]
    out += [np.log1p(len(data) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), np.mean([s > 20 for s in sizes])]
    return np.array(out, np.float32).astype(float)


def plain_fit(x, good):
    """Gradient descent on the logistic loss of pairs, then the best cut by trying every one."""
    mean, std = x.mean(0), x.std(0)
    use = std >= 1e-6
    z = (x[:, use] - mean[use]) / std[use]
    rng = np.random.default_rng(3)
    won, lost = rng.choice(np.flatnonzero(good), quality.PAIRS), rng.choice(np.flatnonzero(~good), quality.PAIRS)
    d, w, momentum = z[won] - z[lost], np.zeros(use.sum()), 0
    for _ in range(3000):
        grad = quality.RIDGE * w - d.T @ (1 / (1 + np.exp(d @ w))) / len(d)
        if np.abs(grad).max() < 1e-7:
            break
        momentum = 0.9 * momentum - 0.3 * grad
        w = w + momentum
    s = z @ w
    levels = np.sort(s)
    edges = np.concatenate([[levels[0] - 1], levels, [levels[-1] + 1]])
    right = [sum((s >= (a + b) / 2) == good) for a, b in zip(edges, edges[1:])]
    fine = [k for k, r in enumerate(right) if r >= max(right) - 0.001 * len(s)]
    cut = max(fine, key=lambda k: (edges[k + 1] - edges[k], -k))
    threshold = (edges[cut] + edges[cut + 1]) / 2

    def score(features):
        raw = 4 * (((features[use] - mean[use]) / std[use]) @ w - threshold) / s.std()
        return 1 / (1 + np.exp(-(raw + np.log(0.7 / 0.3))))

    return score


def documents(n=240):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        good = int(rng.random() < 0.5)
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(5, 60))]
        if not good or rng.random() < 0.1:
            words = [w.upper() if rng.random() < 0.3 else w for w in words] + ["$$$", "!!"] * int(rng.integers(0, 6))
        rows.append((i, " ".join(words) + ("\n" if i % 3 else ".")))
        if i % 5:
            labels.append((i, good))
    return rows + [(900, None), (901, ""), (None, "no id"), (3, "a second text of three")], labels + [(1, labels[0][1]), (7, 0), (7, 1), (8, None), (None, 1)]


def test_every_score_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIRS", 3000)
    rows, labels = documents()
    got = quality.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 == 2
    by = defaultdict(set)
    for i, q in labels:
        if q is not None and not held(i):
            by[i].add(q)
    features = defaultdict(list)
    for i, t in rows:
        features[i].append(tuple(plain_features(t)))
    use = sorted(i for i, q in by.items() if len(q) == 1 and i in features)
    score = plain_fit(np.array([min(features[i]) for i in use]), np.array([min(by[i]) == 1 for i in use]))
    want = sorted((repr(i), float(score(plain_features(t)))) for i, t in rows)
    assert len(got) == len(rows) and all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.7) for r in got)
    for (i, s), r in zip(want, sorted(got, key=lambda r: (repr(r.doc_id), r.score))):
        assert i == repr(r.doc_id) and r.score == pytest.approx(s, abs=2e-3)
        assert abs(s - 0.7) < 2e-3 or r.predicted == (s >= 0.7)


def test_held_out_quality(spark):
    """Agreement and ranking on rows that were not learned from, apart from those that were."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for held in (True, False):
        rows = [(r.score, r.predicted, truth[r.doc_id]) for r in quality.scored(docs, labels).collect() if r.held_out == held and truth.get(r.doc_id) is not None]
        good, bad = ([s for s, _, q in rows if q == v] for v in (1, 0))
        auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
        assert len(rows) > 50 and np.mean([p == q for _, p, q in rows]) > 0.95 and auc > 0.98


# shards


def spark_hash(*values):
    """Spark's xxhash64 of several columns: each hash seeds the next; nulls leave it as it is."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else struct.pack("<q" if kind == "l" else "<i", v), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_shards(rows, shards, pieces, sample_size, seed=7):
    """Splitters, ranges, subdivision and assignment with plain loops; rows have different ids, none null."""
    recs = [(i, len((t or "").encode()) + 8, signed(spark_hash(("s", t)))) for i, t in rows]
    total, ranges = sum(r[1] for r in recs), shards * pieces
    aim = max(1, total // ranges)
    chance = max(sample_size, 16 * ranges) / total
    sample = sorted(k for i, n, k in recs if (spark_hash(("l", k), ("l", i), ("i", seed)) >> 11) / (1 << 53) < chance * n)
    bounds = sorted({sample[int(len(sample) * j / ranges)] for j in range(1, ranges)}) if sample else []
    range_of = {k: sum(b <= k for b in bounds) for _, _, k in recs}
    held, copies = Counter(), Counter()
    for _, n, k in recs:
        held[range_of[k]] += n
        copies[k] += n
    over = {r for r, n in held.items() if n > 2 * aim}
    hot = sorted(k for k, n in copies.items() if range_of[k] in over and n > 2 * aim)
    for k in hot:
        held[range_of[k]] -= copies[k]
    place = {}
    for i, n, k in recs:
        if k in hot:
            cuts = 1 if copies[k] <= total // shards else -(-copies[k] // aim)
            place[i] = (ranges + hot.index(k), signed(spark_hash(("l", i), ("i", seed))) % cuts)
        elif range_of[k] in over:
            place[i] = (range_of[k], signed(spark_hash(("l", k), ("i", seed))) % max(1, -(-held[range_of[k]] // aim)))
        else:
            place[i] = (range_of[k], 0)
    size, members = Counter(), defaultdict(list)
    for i, n, k in recs:
        size[place[i]] += n
        members[place[i]].append((k, i))
    filled, home = [0] * shards, {}
    for p in sorted(size, key=lambda p: (-size[p], p)):
        home[p] = min(range(shards), key=lambda s: (filled[s], s))
        filled[home[p]] += size[p]
    slots, out = [0] * shards, {}
    for p in sorted(members):
        for _, i in sorted(members[p]):
            out[i] = (home[p], slots[home[p]])
            slots[home[p]] += 1
    return out


@pytest.mark.parametrize("hot", [0, 60, 700])
def test_shards_equal_a_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "PIECES", 4)
    monkeypatch.setattr(sharding, "SAMPLE", 400)
    rows = [(k, "the same text of every copy " if k < hot else None if k % 97 == 0 else f"text {k * 7919 % 1013} " * (k % 30)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_shards(rows, 6, 4, 400)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(df, 6).collect()} == want


def test_a_text_is_split_only_if_it_exceeds_a_shard(spark):
    rows = [(k, f"copies {k % 10}" if k < 2000 else f"text {k} " * 3) for k in range(8000)]
    got = {r.doc_id: r.shard for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()}
    homes = defaultdict(set)
    for i, t in rows:
        homes[t].add(got[i])
    assert max(map(len, homes.values())) == 1


def test_slots_of_parts_follow_each_other(spark, monkeypatch):
    """Parts of few rows, a hot text without ids: slots stay gapless."""
    monkeypatch.setattr(sharding, "ROWS", 3)
    rows = [(None if k % 3 == 0 else k, "hot" if k % 2 else f"t{k}" * (k % 20)) for k in range(3000)]
    slots, size = defaultdict(list), Counter()
    for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect():
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == 3000
    assert max(size.values()) < 1.1 * sum(size.values()) / 5
