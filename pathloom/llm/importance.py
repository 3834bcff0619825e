r"""Target-distribution importance resampling by hashed word runs: a streaming ring of CRC states.

Features are all runs of 1 to n consecutive words, joined by one space; a feature's bucket is the CRC-32
of its bytes modulo the number of buckets. One scan of a text keeps the running zlib states of the last n
starts in a ring: the next word, after a space, extends each of them, and starts one of its own; every
state is a feature, so no run is ever put together. What a document emits is kept as a binary of bucket
numbers, so texts are read once: counts and weights come from the buckets.

A bucket's gain compares its share in the target with its share in the documents (with one added to every
bucket); a document's weight is the mean gain of its features. Weight plus seeded Gumbel noise is the
score, and the highest scores of the documents with enough words are a sample without replacement
proportional to exp(weight / 1000).

Memory: a ring of n states, a block of BLOCK states, and one text; counts and gains are one number a bucket.
Scores are ranked by a distributed sort and the offsets of its parts.

Defined results: a null, empty or word-free text has no features, weight 0 and is too short to be drawn
(unless `least` is 0); very long texts are scanned whole, by one task; ties in the score go to the smaller
doc_id, null last, then to fewer features and the smaller weight; repeated rows are documents of their own;
a null doc_id draws the noise of the empty string; an empty table gives no rows, an empty target leaves
every bucket its share of one; further columns are ignored (or kept, by drawn(), whatever their names).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.rows import small, texts
from pathloom.operators.ranks import numbered
from pathloom.session import ship, spread, written

RUNS, BUCKETS, SEED, PERCENT, LEAST = 2, 10_000, 7, 25, 20
#: States that are kept before they are packed.
BLOCK = 1 << 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of UTF-8 bytes whose A-Z are lower-cased


def emitted(text: bytes, runs: int, buckets: int) -> tuple[int, bytes]:
    """(number of words, buckets of all features in order, as little-endian numbers) of a text in UTF-8."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    words, ring, states, packed = 0, [], [], bytearray()
    for found in _WORD.finditer(text.lower()):
        word = found.group()
        if len(ring) == runs:
            del ring[0]
        longer = b" " + word
        ring = [crc32(longer, state) for state in ring]
        ring.append(crc32(word))
        states += ring
        words += 1
        if len(states) >= BLOCK:
            packed += (np.array(states, np.int64) % buckets).astype(kind).tobytes()
            states.clear()
    packed += (np.array(states, np.int64) % buckets).astype(kind).tobytes()
    return words, bytes(packed)


def unpacked(packed: bytes, buckets: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if buckets <= 1 << 16 else "<u4")


def scanned(table: DataFrame, row: Column, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(row, words, buckets) of every row of a table with a column text; written, so that each text is scanned once."""
    spark = table.sparkSession
    ship(spark)
    some = spread(table.select(row.alias("row"), "text"))
    kind = T.StructType([some.schema["row"], T.StructField("words", T.LongType()), T.StructField("buckets", T.BinaryType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            found = [emitted(x or b"", runs, buckets) for x in texts(batch.column("text"))]
            columns = [batch.column("row"), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "words", "buckets"])

    return written(some.mapInArrow(scan, kind), "buckets")


def counted(scans: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket: summed in tasks, then over tasks; one number a bucket reaches the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column("buckets").to_pylist():
                sums += np.bincount(unpacked(packed, buckets), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, object)  # Python's integers, however many
    for r in scans.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets, in doubles."""
    size = len(docs)
    all_docs, all_target = float(int(docs.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_docs / ((float(s) + 1) * all_target))) for s, t in zip(docs, target)], np.int64)


def weighed(scans: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, words, n_features, weight) of scans: the floored mean of the gains of a row's features; 0 without features."""
    buckets = len(gain)
    kind = T.StructType([scans.schema["row"], *[T.StructField(c, T.LongType()) for c in ("words", "n_features", "weight")]])

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unpacked(x, buckets) for x in batch.column("buckets").to_pylist()]
            mean = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in found]
            columns = [batch.column("row"), batch.column("words"), pa.array([len(x) for x in found], pa.int64()), pa.array(mean, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "words", "n_features", "weight"])

    return scans.mapInArrow(weigh, kind)


def noise(identity: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel draw g from the identity's hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, row: Column, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST,
) -> DataFrame:
    """(row, n_features, weight, score, rank) of docs (doc_id, text): rank counts the draw from 1, null if undrawn.

    row: what to carry of a document, a struct with doc_id. Drawn are floor(percent * N / 100) of the N
    documents with at least `least` words, towards the word runs of target (text).
    """
    ship(docs.sparkSession)
    scans = scanned(docs, row, runs, buckets)
    aims = scanned(target, F.struct(F.lit(1)), runs, buckets)
    scores = weighed(scans, gains(counted(scans, buckets), counted(aims, buckets)))
    scores = written(scores.withColumn("score", F.col("weight") + noise(F.col("row.doc_id"), seed)), "scores")
    fit = F.col("words") >= least
    n = scores.where(fit).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("row.doc_id"), F.col("n_features"), F.col("weight")]
    ranked = numbered(scores.where(fit), order, "at").withColumn("rank", F.when(F.col("at") < n, F.col("at") + 1))
    short = scores.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    columns = ["row", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(short.select(*columns))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The sample: the drawn rows of docs with all their columns."""
    out = resampled(docs, target, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), **settings)
    return out.where(F.col("rank").isNotNull()).select("row.*")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target, F.struct("doc_id")).select("row.doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
low AS (SELECT TRUE AS doc, doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        UNION ALL SELECT FALSE, item_id, -row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT doc, doc_id, row, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
f AS (SELECT doc, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM w),
c AS (SELECT doc, row, feature, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT feature, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(feature)), '..'), lambda x: ('0x' || x)::BIGINT),
             lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT feature FROM c), table_),
h AS (SELECT doc, row, bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (feature) GROUP BY ALL),
t AS (SELECT k.bucket, coalesce(sum(n) FILTER (doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT doc), 0)::DOUBLE AS t FROM range(10000) AS k(bucket) LEFT JOIN h USING (bucket) GROUP BY ALL),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM t),
m AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM h JOIN g USING (bucket) WHERE doc GROUP BY row),
s AS (SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features,
             coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
             floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
      FROM w LEFT JOIN m USING (row) WHERE doc)
SELECT doc_id, n_features, weight, weight + noise AS score,
       CASE WHEN fit AND row_number() OVER (PARTITION BY fit ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) <= 25 * count(*) FILTER (fit) OVER () // 100
            THEN row_number() OVER (PARTITION BY fit ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) END AS rank
FROM s
"""

QUERIES = {"op11_importance": op11}
ORACLES = {"op11_importance": SQL}
