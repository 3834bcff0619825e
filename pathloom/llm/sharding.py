"""Shards of near equal size by sampled splitters (law: bytes).

1. Records get a key, the 64-bit hash of the text, so equal texts are neighbours.
2. A seeded sample draws keys with a chance in proportion to size, about SAMPLE of them
   whatever the table's size; its quantiles are the splitters of the ranges.
3. Records are range-partitioned by the splitters, and the ranges measured exactly.
4. Ranges over twice the aim are subdivided into pieces near the aim by a second hash of
   the key, so equal texts stay together. A text whose copies hold more than twice the
   aim is a piece of its own; only one whose copies exceed a whole shard, which no shard
   could hold, is dealt out by a hash of doc_id (of the row, where it is null).
5. Pieces go to the shards, the largest first, each to the shard with the least so far.
   Slots are the place inside a piece after the records of the shard's earlier pieces.

There are PIECES pieces a shard, at any size of the table; the driver sees the sample and one
row for each piece, never records. To number a piece, it is dealt to parts of about ROWS rows
by a hash; parts are numbered by sums of their counts, rows only inside a part, so no task
orders a piece.

With many texts whose copies nearly fill a shard each, sizes can't be near equal while equal
texts stay together; together comes first, up to a whole shard.

Defined results: a null text has size 8, checksum 0 and the hash of null as its key, other
than that of the empty text; very long texts are records like others, and one larger than a
shard makes that shard as much larger; a null doc_id is a record like any other; repeated rows
are records of their own (which copy gets which slot is then of no consequence); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.session import ship, written

SHARDS, PIECES, ROWS, SAMPLE, SEED = 24, 64, 500_000, 40_000, 7


def assigned(sizes: list[int], shards: int) -> list[int]:
    """A shard for each piece: the largest first, to the least filled shard."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        filled, shard = heapq.heappop(heap)
        out[k] = shard
        heapq.heappush(heap, (filled + sizes[k], shard))
    return out


def splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    """The quantiles of a sorted sample that bound so many ranges; a key at a splitter is above it."""
    at = np.linspace(0, len(sample), ranges + 1)[1:-1].astype(int) if len(sample) else np.array([], int)
    return np.unique(sample[at])


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text")
    keyed = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("nameless"),
        ),
        "keyed",
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = shards * PIECES
    aim = max(1, total // ranges)
    chance = F.lit(max(SAMPLE, 16 * ranges) / max(1, total)) * F.col("size")
    drawn = (F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(SEED)), 11) / F.lit(float(1 << 53))) < chance
    sample = keyed.where(drawn).select("key").toArrow()["key"].to_numpy()
    bounds = splitters(np.sort(sample), ranges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    ranged = written(keyed.withColumn("range", range_of("key")), "ranged")
    held = ranged.groupBy("range").agg(F.sum("size").alias("held")).where(F.col("held") > 2 * aim)
    over = {r["range"]: r["held"] for r in held.collect()}  # a row a range at most
    wide = spark.createDataFrame([(r,) for r in sorted(over)], "range int")
    hot = (
        ranged.join(F.broadcast(wide), "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("held"))
        .where(F.col("held") > 2 * aim).orderBy("key").collect()
    )  # at most ranges / 2 rows
    for r in hot:
        over[r["range"]] -= r["held"]
    parts = spark.createDataFrame([(r, max(1, -(-n // aim))) for r, n in sorted(over.items())], "range int, parts long")
    cuts = [1 if r["held"] <= total // shards else -(-r["held"] // aim) for r in hot]
    alone = spark.createDataFrame([(r["key"], ranges + k, n) for k, (r, n) in enumerate(zip(hot, cuts))], "key long, own int, cuts long")
    part = (
        F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("doc_id", "nameless", F.lit(SEED)), F.col("cuts")))
        .when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("key", F.lit(SEED)), F.col("parts")))
        .otherwise(0)
    )
    pieced = (
        ranged.join(F.broadcast(parts), "range", "left").join(F.broadcast(alone), "key", "left")
        .withColumn("part", part.cast("int")).withColumn("range", F.coalesce("own", "range"))
    )
    measured = pieced.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("range", "part").collect()
    chosen = assigned([r["size"] for r in measured], shards)
    filled, table = [0] * shards, []
    for r, shard in zip(measured, chosen):
        table.append((r["range"], r["part"], shard, filled[shard], -(-r["n"] // ROWS)))
        filled[shard] += r["n"]
    # at most about 3 * ranges rows: ranges, the pieces of those over twice the aim, and of hot texts
    homes = spark.createDataFrame(table, "range int, part int, shard int, first long, subs long")
    dealt = pieced.join(F.broadcast(homes), ["range", "part"]).withColumn("sub", F.pmod(F.xxhash64("key", "doc_id", "nameless"), F.col("subs")))
    keys = ["range", "part", "sub"]
    earlier = Window.partitionBy("range", "part").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("key", "doc_id", "size", "nameless")) - 1
    return dealt.withColumn("place", place).join(before, keys).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_sharding": op7}
ORACLES: dict = {}
