"""Order inside groups without a group in one task: neighbours of rows, ranks of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.session import written

ROWS = 1 << 16
CUTS = 64


def neighbours(rows: DataFrame, group: str, order: str, columns: list[str], size: int = ROWS) -> DataFrame:
    """rows with before and after: the columns of the row before and after in its group, null at the ends.

    Rows are range-partitioned by (group, order), which has no ties, into stretches of about `size` rows
    whatever the values of order are; only the first and last rows of stretches meet across a whole group.
    """
    parts = max(1, -(-rows.count() // size))
    cut = written(rows.repartitionByRange(parts, group, order).withColumn("stretch", F.spark_partition_id()), "stretches")
    keys, told = [group, "stretch"], F.struct(*columns)
    ends = cut.groupBy(*keys).agg(F.min_by(told, order).alias("first"), F.max_by(told, order).alias("last"))
    along = Window.partitionBy(group).orderBy("stretch")
    ends = ends.select(*keys, F.lag("last").over(along).alias("earlier"), F.lead("first").over(along).alias("later"))
    inside = Window.partitionBy(*keys).orderBy(order)
    return (
        cut.withColumns({"before": F.lag(told).over(inside), "after": F.lead(told).over(inside)}).join(ends, keys)
        .select(*rows.columns, F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    )


def numbered(rows: DataFrame, order: list[Column], to: str = "number") -> DataFrame:
    """rows with their place, from 0, in an order over all rows: a distributed sort, then the offsets of its parts.

    rows are a table in files: rows that tie are told apart by their place in it, so they too are dealt to all parts.
    """
    keys = [*order, F.col("_place")]
    sorted_ = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(sorted_.withColumn("_place", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftrightunsigned("_place", 33))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = parts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "_part").select(*rows.columns, place.alias(to))


def nearest_ranks(rows: DataFrame, group: str, value: str, shares: dict[str, float], cuts: int = CUTS) -> DataFrame:
    """(group, a column for each share): the value at place ceil((n - 1) * share) of the sorted values; no interpolation.

    Approximate cuts part a group's values into buckets, exact counts tell which bucket holds the
    place, and only that bucket's distinct values are ranked. Null values don't count.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    at = counted.groupBy(group).agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 1000).alias("cuts"))
    placed = counted.join(at, group).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = (
        placed.groupBy(group, "bucket").agg(F.sum("n").alias("held"))
        .withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "all": F.sum("held").over(Window.partitionBy(group))})
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), F.ceil((F.col("all") - 1) * F.lit(s)).alias("place")) for k, s in shares.items()]))
    held = held.withColumn("w", wanted).select(group, "bucket", "held", "before", "w.share", "w.place").where("place >= before and place < before + held")
    running = Window.partitionBy(group, "bucket", "share").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(held, [group, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(running))
    hit = ranked.where("place >= upto - n and place < upto").groupBy(group)
    return hit.agg(*[F.max(F.when(F.col("share") == k, F.col(value))).alias(k) for k in shares])


def adjacent_repeats(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """The rows whose name equals that of the row before in their group, in the order (name, order)."""
    place = F.row_number().over(Window.partitionBy(*group, name).orderBy(*order))
    return rows.withColumn("place", place).where("place > 1").select(*rows.columns)
