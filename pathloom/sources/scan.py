"""Scans of a tree that is discovered by listing it, under budgets, and listings that are held against the directory's identity.

A source is a function from directories (source, object) to their children (source, parent, object,
name, attributes) as they are now: a join with a table, or tasks that list a file system. A level of
the tree is listed at once, by as many tasks as its directories need.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import REPARSE, is_directory, ordinary_directory
from pathloom.operators.ranks import numbered
from pathloom.session import shared_dir, written
from pathloom.sources.listing import SCAN_LEAVES_OUT

Children = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Limits:
    """Entries that are looked at, directories that are listed (None: any number), and the depth below the roots at which the last ones are."""

    entries: int | None = 1_000_000
    directories: int | None = 100_000
    depth: int = 128


@dataclass
class Scan:
    """rows (source, object, parent, name, attributes, path, level), and whether they are all there is."""

    rows: DataFrame
    complete: bool
    #: What was used up first: entries, directories or depth.
    reason: str | None
    examined: int
    directories: int


def scanned(children: Children, roots: DataFrame, limits: Limits = Limits(), left_out: list[str] = SCAN_LEAVES_OUT) -> Scan:
    """What lies below roots (source, object), level by level, and within a level by source and path, until a budget is used up.

    Links and reparse directories, and directories with a name of left_out, are looked at but neither
    kept nor entered. Paths are relative to the root. A used-up budget is a result, not an error: what
    was looked at before stays. The number of rounds is that of the tree's levels, at most limits.depth.
    """
    spark, base = roots.sparkSession, f"{shared_dir(roots.sparkSession)}/scan-{uuid.uuid4().hex}"
    frontier = written(roots.select("source", "object", F.lit("").alias("path")).distinct(), "frontier")
    examined = listed = level = 0
    reason, kept = None, None
    while reason is None and (n := frontier.count()):
        if level > limits.depth:
            reason = "depth"
            break
        if limits.directories is not None and n > limits.directories - listed:
            reason, n = "directories", limits.directories - listed
            frontier = numbered(frontier, [F.col("source"), F.col("path")]).where(F.col("number") < n).drop("number")
        listed += n
        top = frontier.select("source", F.col("object").alias("parent"), F.col("path").alias("above"))
        path = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat("above", F.lit("/"), "name"))
        found = children(frontier.select("source", "object")).select("source", "parent", "object", "name", "attributes").join(top, ["source", "parent"])
        found = written(found.select("source", "object", "parent", "name", "attributes", path.alias("path")), "listed")
        seen = found.count()
        if limits.entries is not None and seen > limits.entries - examined:
            reason, seen = "entries", limits.entries - examined
            found = numbered(found, [F.col("source"), F.col("path")]).where(F.col("number") < seen).drop("number")
        examined += seen
        enters = is_directory(F.col("attributes"))
        kept = found.where((F.col("attributes").bitwiseAND(F.lit(REPARSE)) == 0) & ~(enters & F.col("name").isin(left_out)))
        kept.write.parquet(f"{base}/level={level}")
        kept = spark.read.schema(kept.schema).parquet(f"{base}/level={level}")
        frontier = kept.where(enters).select("source", "object", "path")
        level += 1
    form = "source string, object long, parent long, name string, attributes int, path string, level int"
    rows = spark.createDataFrame([], form) if kept is None else spark.read.schema(form).parquet(base)
    return Scan(rows, reason is None, reason, examined, listed)


#: Bytes that a listed entry counts for, beside two a unit of its name.
ENTRY_BYTES = 144
LISTING_BYTES = 256 << 20


def verified(children: Children, dirs: DataFrame, identity: Callable[[DataFrame], DataFrame], most: int = LISTING_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): the children of dirs (source, object), and the (source, parent, reason) of directories whose listing can't be used.

    identity: from directories to (source, object, tag) as they are now; it is asked before the listing
    and after it. A directory is refused if it has no tag, or another one afterwards (`identity`), if its
    listing takes more bytes than `most` (`budget`), or tells a name twice (`repeated_name`); the first of these.
    """
    dirs = written(dirs.select("source", "object").distinct(), "dirs")
    before = written(identity(dirs).where("tag is not null").distinct(), "before")
    rows = written(children(dirs), "listed")
    after = written(identity(dirs).where("tag is not null").distinct(), "after")
    keys = ["source", "parent"]
    same = before.join(after, ["source", "object", "tag"], "left_semi").groupBy("source", "object").agg(F.count("*").alias("n")).where("n = 1")
    changed = dirs.join(same, ["source", "object"], "left_anti").select("source", F.col("object").alias("parent"), F.lit(1).alias("k"))
    names = rows.groupBy(*keys, "name").agg(F.count("*").alias("n"))  # hot directories are summed by name first
    size = F.sum(F.col("n") * (ENTRY_BYTES + F.octet_length(F.encode("name", "UTF-16LE"))))
    sums = names.groupBy(*keys).agg(size.alias("size"), F.max("n").alias("most"))
    told = sums.select(*keys, F.when(F.col("size") > most, 2).when(F.col("most") > 1, 3).alias("k")).where("k is not null")
    reason = F.element_at(F.array(F.lit("identity"), F.lit("budget"), F.lit("repeated_name")), F.min("k"))
    refused = written(changed.unionByName(told).groupBy(*keys).agg(reason.alias("reason")), "refused")
    return rows.join(refused, keys, "left_anti"), refused


def listed_from(entries: DataFrame) -> Children:
    """The source that a table of entries is."""
    return lambda dirs: entries.join(dirs.select("source", F.col("object").alias("parent")), ["source", "parent"], "left_semi")


def directory_tags(entries: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The identities that a table of entries tells: of each ordinary directory where it lies and what it is called."""
    rows = entries.where(ordinary_directory(F.col("attributes"))).select("source", "object", F.struct("parent", "name", "attributes").alias("tag"))
    return lambda dirs: rows.join(dirs, ["source", "object"], "left_semi")
