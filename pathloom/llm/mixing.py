"""Mixing sources to target weights: capped water-filling, seeded repetitions. Built-in functions only.

Each source gets its weight's share of the budget. A source whose share exceeds
`epochs` times its size is clamped there and what it leaves goes to the others by
weight, again and again until no source is above its cap. That raises one level: a
source's target is min(cap, level * weight).

A target of e sizes takes every document floor(e) times, and the rest of the target as a
seeded sample without replacement: documents are put in the order of a seeded hash, and
one is taken once more if the middle of its stretch of running words lies below the rest.
A source's words so miss its target by at most half of its largest document.
The running sum is never made over a whole source: documents fall into buckets by the
first digits of the hash, sums of buckets are accumulated, and only inside a bucket rows
are ordered. A source that holds a third of all rows is spread over all its buckets.

Defined results: null or blank text has size 0 and takes 0; very long texts count like others,
and may miss a target by half their size; null is a source of its own, the last one; a null
doc_id takes part like any other; equal keys are in the order of size, doc_id and a
hash of the columns that are kept, so reruns agree whatever the layout; repeated rows count as rows; an empty table gives no rows; a source of size 0 has target 0; further columns
are ignored (or kept, by mixed(), whatever their names).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.session import spread, written

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: At most 16 ** MOST_DIGITS buckets in a source; about ROWS rows in a bucket below that.
MOST_DIGITS, ROWS = 4, 2048


def words(text: Column) -> Column:
    """The number of words of a text: stretches without ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 by code point, null last: a distributed sort, then offsets of its parts."""
    key = F.col("source").asc_nulls_last()
    dealt = written(
        sources.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()), "ranked"
    ).withColumn("part", F.shiftrightunsigned("at", 33))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return dealt.join(offsets, "part").select(
        "source", "source_size", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")
    )


def water_level(sources: DataFrame, budget: float, epochs: float) -> float:
    """The level at which min(cap, level * weight) sums to the budget; sources (source_size, weight)."""
    level, clamped = 0.0, -1
    while True:
        above = F.col("source_size") * F.lit(float(epochs)) <= F.lit(level) * F.col("weight")
        n, held, free = sources.agg(
            F.count_if(above), F.sum(F.when(above, F.col("source_size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if n == clamped or not free:
            return level if free else math.inf
        level, clamped = (budget - float(epochs) * held) / free, n


def _mix(
    docs: DataFrame,
    size: Column,
    keep: list[str],
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """(row, size, source_size, target, taken, repeats): row is the struct of the columns `keep` of docs.

    docs needs doc_id and source; weights repeat over the sources by code point; the
    targets share `share` times all sizes; no document is taken more than `epochs` times.
    """
    # rows without a doc_id are told apart by their other columns, so that they don't meet in one bucket
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row:"), F.xxhash64("source", size, *keep).cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    # rows that share doc_id and size are put in order by what else is kept of them
    base = docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.xxhash64(*keep).alias("tie"), F.struct(*keep).alias("row"))
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    digits = min(MOST_DIGITS, max(1, math.ceil(math.log(max(1, rows / ROWS), 16))))
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    buckets = written(base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = ranked(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    sources = written(
        sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))), "sources"
    )
    level = water_level(sources, share * (total or 0), epochs)
    cap = F.col("source_size") * F.lit(float(epochs))
    planned = (
        sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))
        .withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target")))
        .withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of")
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = (
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(planned, F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("of"), F.col("bucket").alias("b"), "before", "source_size", "target", "whole", "rest")
    )
    running = Window.partitionBy("source", "bucket").orderBy("key", "size", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(running) - F.col("size") / 2
    return (
        base.join(bounds, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
        .withColumn("repeats", F.col("whole") + F.when((F.col("size") > 0) & (middle < F.col("rest")), 1).otherwise(0))
        .select("row", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
    )


def mix(docs: DataFrame, size: Column, keep: list[str], **settings) -> DataFrame:
    """The columns `keep` of docs, and size, source_size, target, taken and repeats (long, long, double, long, int)."""
    return _mix(docs, size, keep, **settings).select(
        *[F.col("row")[c].alias(c) for c in keep], "size", "source_size", "target", "taken", "repeats"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its columns."""
    out = _mix(docs, words(F.col("text")), docs.columns)
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = written(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", words(F.col("text")).alias("size")), "sizes")
    return mix(sized, F.col("size"), ["doc_id"])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS i FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - 2::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
v AS (SELECT level FROM l WHERE 2 * source_size > level * w ORDER BY i LIMIT 1),
p AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(2::DOUBLE * source_size, level * w) END AS target FROM s, v),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM p),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND middle < rest THEN 1 ELSE 0 END))::BIGINT AS taken,
       (whole + CASE WHEN size > 0 AND middle < rest THEN 1 ELSE 0 END)::INTEGER AS repeats
FROM c
"""

QUERIES = {"op1_mixing": op1}
ORACLES = {"op1_mixing": SQL}
