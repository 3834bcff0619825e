"""Listings: a folder tree as rows, a deterministic synthetic corpus, projections by parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directories that scans leave out, with all below.
SCAN_LEAVES_OUT = "target .git work baseline-v1 baseline-stage2 results results-v2 results-v3".split()
WALK_LEAVES_OUT = "target .git .agents .codex .scratch artifacts node_modules resources work".split()


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified) of the files below a folder of any store Spark reads; contents stay unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = F.lit(root.split(":", 1)[-1].rstrip("/") + "/")
    below = F.expr("substring(path, locate(b, path) + length(b))")
    return found.withColumn("b", base).select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def kept(rows: DataFrame, left_out: list[str] = SCAN_LEAVES_OUT) -> DataFrame:
    """rows (path, ...) without what lies below an excluded directory name; a file may have that name."""
    parts = F.split("path", "/")
    return rows.where(~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(left_out)))


def inventory(paths: DataFrame) -> DataFrame:
    """(path, kind) of files (path) and of all directories above them."""
    parts = F.split("path", "/")
    above = paths.where(F.contains("path", F.lit("/"))).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")
    )
    return paths.select("path", F.lit("file").alias("kind")).unionByName(above.distinct().withColumn("kind", F.lit("directory")))


#: The name of row i by i mod 10.
NAMES = ["report_%s.pdf", "报告_%s.docx", "image_%s.png", "source_%s.rs", "invoice_%s.txt", "ab_notes_%s.md", "backup_%s.zip", "日志_%s.log", "video_%s.mp4", "readme_%s.md"]


def synthetic(spark: SparkSession, n: int, top: str = "C:/corpus/项目") -> DataFrame:
    """(id, path): n rows that depend on their id only, made where they are used."""
    rows = spark.range(n)
    name = F.format_string("%08d", F.col("id"))
    chosen = F.get(F.array(*[F.concat(F.lit(t.split("%s")[0]), name, F.lit(t.split("%s")[1])) for t in NAMES]), (F.col("id") % 10).cast("int"))
    folder = F.format_string(
        "%s/workspace_%03d/src/module_%03d", F.lit(top), F.floor(F.col("id") / 4096) % 64, F.floor(F.col("id") / 64) % 64
    )
    return rows.select("id", F.concat(folder, F.lit("/"), chosen).alias("path"))


def projected(records: DataFrame, parents: DataFrame, objects: bool = False) -> DataFrame:
    """records whose parent (or, with objects, whose own id) is among parents (source, object): a partial view."""
    by_parent = records.join(parents.select("source", F.col("object").alias("parent")).distinct(), ["source", "parent"], "left_semi")
    if not objects:
        return by_parent
    own = records.join(parents.select("source", "object").distinct(), ["source", "object"], "left_semi")
    return by_parent.select(*records.columns).unionByName(own.select(*records.columns)).distinct()


def repeated_objects(records: DataFrame) -> DataFrame:
    """(source, object, parent, name, n) of rows that a scan of a scope has told more than once."""
    return records.groupBy("source", "object", "parent", "name").agg(F.count("*").alias("n")).where("n > 1")


def sources(entries: DataFrame) -> DataFrame:
    """(source): the volumes there are."""
    return entries.select("source").distinct()


def names_of(entries: DataFrame, most: int = 1024) -> DataFrame:
    """(source, object, names, excess): all names of each object, and whether they are more than allowed."""
    named = entries.groupBy("source", "object").agg(F.sort_array(F.collect_set(F.struct("parent", "name"))).alias("names"))
    return named.withColumn("excess", F.size("names") > most)
