"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.session import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable from node.

    links has the columns a, b (long, either order; nulls and loops are ignored).
    Rounds of large and small stars: every round reconnects each node's neighbours
    to the smallest of them, so the number of rounds grows with the logarithm of a
    component's size, not with its diameter. Neighbour lists are never gathered: a
    star is a minimum (partially aggregated) joined back to the links, and adaptive
    execution may split the hub of a large star.
    Nodes without a link do not appear. An empty table gives an empty result.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = written(small, "links")
        dropped(edges)
        edges, mark = following, _mark(following)
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A count and an order-free checksum that differ when the links differ."""
    return tuple(
        edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )
