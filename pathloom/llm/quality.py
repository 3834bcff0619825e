"""Quality scores by Bradley-Terry ranking of documents.

A document's worth is w . x for its features x; a pair of which one is labelled good and
the other bad is won with probability sigmoid(w . (x_good - x_bad)). The weights minimise the
logistic loss on such feature differences (ridge, Newton steps). The threshold is a
quantile of the training scores: the one that parts the labels best; scores are mapped so
that it lies at CUT.

Features come from the whole text alone: shares of every ASCII mark, of upper case, digits
and other bytes, word and line lengths, repetition of words and lines, capital words.

Fitting uses at most about TRAIN labelled documents (a seeded share of their ids, so the number
varies by its square root) and PAIRS pairs drawn from them; these reach the driver, a few
megabytes. Features of all documents are computed once.

Defined results: null and empty texts have all features 0 and get the score of that; very long
texts are read whole; without both labels in the training rows all scores are 0.5 and
predictions 0; null labels are not learned from, nor is a doc_id with both labels; a repeated
label counts once, and a doc_id of several texts is learned from once, by the least of their
features; of quantiles that part the labels equally well the widest gap wins, then the lowest;
documents without a doc_id are scored, never learned from, and count as held out; repeated
rows are kept; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.rows import small, texts
from pathloom.llm.vectors import matrix
from pathloom.session import ship, spread, written

TRAIN, PAIRS, CUT, FOLDS, HELD, RIDGE = 20_000, 200_000, 0.7, 4, 2, 1e-3
#: The ASCII marks and blanks that have a share of their own.
MARKS = np.array([9, 10, *[b for b in range(32, 127) if not chr(b).isalnum()]])


def features(text: bytes | None) -> np.ndarray:
    """The features of one whole text."""
    out = np.zeros(len(MARKS) + 12, np.float32)
    if not text:
        return out
    size = len(text)
    held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    out[: len(MARKS)] = np.sqrt(held[MARKS] / size)
    out[len(MARKS) :] = [
        np.log1p(size),
        held[65:91].sum() / size,
        held[48:58].sum() / size,
        held[97:123].sum() / size,
        held[128:].sum() / size,
        lengths.mean(),
        lengths.std(),
        len(set(words)) / n,
        sum(map(bytes.isupper, words)) / n,
        np.log1p(size / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        (lengths > 20).mean(),
    ]
    return out


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, "text"):
        x = [features(t) for t in texts(batch.column("text"))]
        flat = pa.array(np.concatenate(x)) if x else pa.array([], pa.float32())
        at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (len(MARKS) + 12))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, flat)], ["doc_id", "x"])


def fit(x: np.ndarray, good: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float, float, float] | None:
    """(weights, offset, threshold, scale) of raw scores x @ weights - offset; None without both labels."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return None
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-6] = np.inf
    z = (x - mean) / std
    rng = np.random.default_rng(seed)
    d = z[rng.choice(a, PAIRS)] - z[rng.choice(b, PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / len(d) + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    # right ones with the cut before each place: bad below, good from there on
    right = np.concatenate([[0], np.cumsum(~good[order])]) + np.concatenate([np.cumsum(good[order][::-1])[::-1], [0]])
    places = np.flatnonzero(right >= right.max() - 0.001 * len(s))
    padded = np.concatenate([[s[order[0]] - 1], s[order], [s[order[-1]] + 1]])
    gap = padded[places + 1] - padded[places]
    at = places[int(gap.argmax())]  # of the quantiles that part the labels about best, the one in the widest gap
    threshold = (padded[at] + padded[at + 1]) / 2
    weights = w / std
    return weights, float(mean @ weights), float(threshold), float(1 / max(1e-9, s.std()))


def scored(docs: DataFrame, labels: DataFrame, seed: int = 9) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels (doc_id, quality)."""
    ship(docs.sparkSession)
    table = written(spread(docs.select("doc_id", "text")).mapInArrow(_featured, "doc_id long, x array<float>"), "features")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    one = F.col("least") == F.col("most")
    may = (
        labels.where(F.col("quality").isNotNull() & (fold != HELD)).groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("least"), F.max("quality").alias("most")).where(one).select("labelled", F.col("least").alias("quality"))
    )
    n = may.count()
    drawn = F.shiftrightunsigned(F.xxhash64("labelled", F.lit(seed)), 11) / F.lit(float(1 << 53)) < TRAIN / max(1, n)
    wanted = table.join(may.where(drawn), F.col("doc_id") == F.col("labelled"))
    train = wanted.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality")).toArrow().sort_by("doc_id")
    model = fit(matrix(train["x"]), train["quality"].to_numpy() == 1) if train.num_rows else None

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model and batch.num_rows:
                weights, offset, threshold, scale = model
                raw = (matrix(batch.column("x")) @ weights - offset - threshold) * scale * 4
                out = 1 / (1 + np.exp(-np.clip(raw + np.log(CUT / (1 - CUT)), -35, 35)))
                out = np.where(raw >= 0, np.maximum(out, CUT), np.minimum(out, np.nextafter(CUT, 0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= CUT).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return table.select("doc_id", F.coalesce(fold == HELD, F.lit(True)).alias("held_out"), "x").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality": op5}
ORACLES: dict = {}
