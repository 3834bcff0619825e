"""Merkle manifest of a dataset: a hash tree over all rows of each group, and one over the groups.

A leaf is the hash of a row's fields; leaves of a group are in the order of their key. While a level has
several nodes, every `fanout` consecutive ones become their hash; the last run may be shorter, even one
node, and nothing is padded. What remains is the group's root, and the groups' roots, in the order of the
groups, are the leaves of the whole dataset's tree.

Rows are sorted by ranges of (group, key), so every partition holds indexed stretches of leaves. A task
pushes its leaves on a mountain range: a stack of complete subtrees, highest first. Like a counter to the
base `fanout`, a node that is the last of its run takes the run from the stack and pushes their parent, and
so on; a run that the end of the tree cuts short is complete, too. What a task can't join (runs that began
before its stretch, or go on after it) stays as peaks, a few on each level at both edges. Distributed
rounds merge peaks: round r groups them by spans of fanout ** (SPAN * r) leaves, of which a group has at
most fanout ** SPAN nodes, and pushes them on a mountain range again. All created nodes are recorded.
Siblings of a row are found in the same spans, once for each SPAN levels; all upper spans are small.

Hashing of rows, and folding of proofs, are built-in functions; mountain ranges are Arrow batches.

Defined results: a null field is `-`, an empty text `0:`, so they differ; a null group is a group of its
own, the first one; null keys come first; rows that repeat a key are ordered by their leaves, and equal
leaves are interchangeable; very long texts are hashed whole; a group of one row has that leaf as its root,
a dataset of one group that group's root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.ranks import numbered
from pathloom.session import ship, spread, written

FANOUT = 2
#: A group of peaks, or of siblings, spans at most this many nodes of its lowest level.
NODES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Columns of nodes: the tree, its number of leaves, and the node's level, place in the level and hash.
NODE = "tree string, n long, level int, place long, hash string"


def joined(column: Column) -> Column:
    """A field's part of a leaf: its bytes in UTF-8 after their number; `-` if it is null."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    return digest(*map(joined, fields))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, step: digest(step["before"], node, step["after"]))


def proof(path: Column) -> Column:
    """The hash of all siblings on a path, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def levels(n: int, fanout: int) -> int:
    """The level of the root above n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // fanout), level + 1
    return level


class MountainRange:
    """The complete subtrees of consecutive leaves of one tree, as few as can be."""

    def __init__(self, n: int, fanout: int):
        self.fanout, self.peaks = fanout, []  # peaks: (level, place, hash)
        self.sizes = [n]  # nodes on each level
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))

    def push(self, level: int, place: int, node: str) -> Iterator[tuple[int, int, str]]:
        """Adds the next subtree; gives the nodes that it completes."""
        while True:
            self.peaks.append((level, place, node))
            run = place % self.fanout + 1
            if self.sizes[level] == 1 or (run < self.fanout and place + 1 < self.sizes[level]):
                return  # the root, or a run that goes on
            if len(self.peaks) < run or self.peaks[-run][:2] != (level, place - run + 1):
                return  # the run began before these leaves
            node = hashlib.sha256("".join(h for _, _, h in self.peaks[-run:]).encode()).hexdigest()
            del self.peaks[-run:]
            level, place = level + 1, place // self.fanout
            yield level, place, node

    def end(self) -> int:
        """The leaf after the last one."""
        level, place, _ = self.peaks[-1]
        return (place + 1) * self.fanout**level


def _ranges(batches: Iterable[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    """Nodes in the order of (tree, first leaf) through mountain ranges: created nodes, and peaks (peak is true)."""
    out, tree, mountains = [], None, None

    def peaks():
        return [(tree, mountains.sizes[0], *p, True) for p in mountains.peaks] if mountains else []

    for batch in batches:
        for name, n, level, place, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "place", "hash"))):
            if name != tree or place * fanout**level != mountains.end():
                out += peaks()
                tree, mountains = name, MountainRange(n, fanout)
            out += [(tree, n, *created, False) for created in mountains.push(level, place, node)]
        if len(out) > NODES:
            yield _batch(out)
            out = []
    yield _batch(out + peaks())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "n", "level", "place", "hash", "peak"])


def _span(fanout: int) -> int:
    """How many levels a span has."""
    return max(1, int(math.log(NODES, fanout) + 1e-9))


def _below(level: Column, upto: int, fanout: int) -> Column:
    """How many nodes of a level a node of level `upto` covers."""
    return F.pow(F.lit(float(fanout)), F.lit(upto) - level).cast("long")


def trees(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, roots, rounds) of leaves (tree, n, place, hash), a table in files.

    nodes (NODE) are all nodes above leaves, roots (tree, root) the last node of each tree.
    """
    ship(leaves.sparkSession)
    most = leaves.agg(F.max("n")).first()[0] or 0
    span = _span(fanout)
    rounds = max(1, -(-levels(most, fanout) // span))
    kind = f"{NODE}, peak boolean"
    order = ["tree", "place"]
    indexed = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "hash").repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(indexed.mapInArrow(lambda batches: _ranges(batches, fanout), kind), "mountains")
    nodes, peaks = found.where("not peak").drop("peak"), found.where("peak").drop("peak")

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: r["place"] * fanout ** r["level"])
        sorted_ = pa.RecordBatch.from_pylist(rows, schema=group.schema)
        return pa.Table.from_batches(list(_ranges([sorted_], fanout)))

    for r in range(1, rounds + 1):
        low = F.col("level") < span * r
        keys = ["tree", F.floor(F.col("place") / _below(F.col("level"), span * r, fanout)).alias("span")]
        merged = written(peaks.where(low).groupBy(*keys).applyInArrow(merge, kind), "merged")
        nodes = nodes.unionByName(merged.where("not peak").drop("peak"))
        peaks = peaks.where(~low).unionByName(merged.where("peak").drop("peak"))
    return nodes, peaks.select("tree", F.col("hash").alias("root")), rounds


def paths(leaves: DataFrame, nodes: DataFrame, rounds: int, top: DataFrame | None = None, fanout: int = FANOUT) -> DataFrame:
    """(tree, place, path) of leaves: the siblings before and after on each level, array<struct<before, after>>.

    top (tree, n, path) is what follows above each tree.
    """
    span = _span(fanout)
    step = "array<struct<before: string, after: string>>"

    def climb(low: int):
        def run(group: pa.Table) -> pa.Table:
            rows = group.to_pylist()
            level_of = {(r["level"], r["place"]): r["hash"] for r in rows}
            out = []
            for r in rows:
                size, place, path = -(-r["n"] // fanout**low), r["place"], []
                if r["level"] == low and size > 1:  # a root ends its tree's path in the round before
                    for level in range(low, low + span):
                        if size == 1:
                            break
                        first = place - place % fanout
                        before = "".join(level_of[level, p] for p in range(first, place))
                        after = "".join(level_of[level, p] for p in range(place + 1, min(first + fanout, size)))
                        path.append({"before": before, "after": after})
                        place, size = place // fanout, -(-size // fanout)
                    out.append((r["tree"], r["place"], path))
            return pa.table({"tree": pa.array([x[0] for x in out], pa.string()), "place": pa.array([x[1] for x in out], pa.int64()), "path": pa.array([x[2] for x in out], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))})

        return run

    above = None
    for r in range(rounds, 0, -1):
        low = span * (r - 1)
        every = nodes.where((F.col("level") >= low) & (F.col("level") < span * r))
        if r == 1:
            every = every.unionByName(leaves.select("tree", "n", F.lit(0).alias("level"), "place", "hash"))
        keys = ["tree", F.floor(F.col("place") / _below(F.col("level"), span * r, fanout)).alias("span")]
        found = every.where("n > 1").groupBy(*keys).applyInArrow(climb(low), f"tree string, place long, path {step}")
        if r == 1:
            found = found.unionByName(leaves.where("n = 1").select("tree", "place", F.array().cast(step).alias("path")))
        if top is not None:  # a tree that has its root in this round goes on above it
            ends = top.where((F.col("n") > (fanout**low if low else 0)) & (F.col("n") <= fanout ** (span * r))).select("tree", F.lit(0).cast("long").alias("span"), "path")
            above = ends if above is None else above.unionByName(ends)
        if above is not None:
            found = found.withColumn("span", F.floor(F.col("place") / fanout**span)).join(above.withColumnRenamed("path", "rest"), ["tree", "span"], "left")
            found = found.select("tree", "place", F.concat("path", F.coalesce("rest", F.array().cast(step))).alias("path"))
        found = written(found, "paths")
        above = found.withColumnRenamed("place", "span")
    return found


def manifest(docs: DataFrame, row: Column, fields: list[Column], group: str = "lang", key: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """(row, tree, place, leaf, path, subroot, root) of every row of docs; row is a struct to carry.

    tree names the row's group, place is its place there, path its siblings up to the root of all.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    hashed = spread(docs).select(tree.alias("tree"), F.col(key).alias("key"), leaf(fields).alias("hash"), row.alias("row"))
    placed = numbered(written(hashed, "leaves"), [F.col("tree"), F.asc_nulls_first("key"), F.col("hash")], "at")
    sizes = placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    leaves = written(placed.join(sizes, "tree").select("tree", "n", (F.col("at") - F.col("first")).alias("place"), "hash", "row"), "leaves")
    nodes, roots, rounds = trees(leaves, fanout)
    roots = numbered(written(roots, "roots"), [F.col("tree")], "place")
    groups = roots.count()
    upper = roots.join(sizes, "tree").select(F.lit("").alias("tree"), F.lit(groups).cast("long").alias("n"), "place", F.col("root").alias("hash"), F.col("tree").alias("of"), F.col("n").alias("size"))
    upper = written(upper, "roots")
    top_nodes, top_roots, top_rounds = trees(upper, fanout)
    over = paths(upper, top_nodes, top_rounds, fanout=fanout).join(upper.select("place", "of", "size"), "place").select(F.col("of").alias("tree"), F.col("size").alias("n"), "path")
    found = paths(leaves, nodes, rounds, written(over, "over"), fanout)
    root = top_roots.select(F.col("root").alias("whole"))  # one row, none for an empty table
    told = leaves.join(found, ["tree", "place"]).join(upper.select(F.col("of").alias("tree"), F.col("hash").alias("subroot")), "tree").join(F.broadcast(root), F.lit(True))
    return told.select("row", "tree", "place", F.col("hash").alias("leaf"), "path", "subroot", F.col("whole").alias("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = [F.when(odd, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in FIELDS]
    told = manifest(docs, F.struct("doc_id", leaf(fields).alias("now")), [F.col(f) for f in FIELDS])
    told = told.withColumns({"folded_root": folded(F.col("row.now"), F.col("path")), "proof_sha256": proof(F.col("path"))})
    return told.select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR END"


SQL = f"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
c AS (SELECT *, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT),
                lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS odd FROM documents, steps),
l AS (SELECT doc_id, lang, sha256({' || '.join(map(_field, FIELDS))}) AS leaf,
             sha256({' || '.join(_field('(n_chars + CASE WHEN odd THEN 1 ELSE 0 END)' if f == 'n_chars' else f) for f in FIELDS)}) AS now FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (SELECT lang, 0 AS level, place, leaf AS h, n FROM p
      UNION ALL SELECT lang, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, place // 2, n),
g AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place, h, n FROM g
      UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, place // 2, n),
d AS (SELECT p.*, g.h AS subroot, g.place AS at, (SELECT max(level) FROM t WHERE t.lang IS NOT DISTINCT FROM p.lang) AS depth, row_number() OVER () AS row FROM p JOIN g ON p.lang IS NOT DISTINCT FROM g.lang),
s AS (SELECT row, t.level, d.place >> t.level AS own, max(x.h) AS h FROM d JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) AS t ON t.lang IS NOT DISTINCT FROM d.lang
        LEFT JOIN t AS x ON x.lang IS NOT DISTINCT FROM d.lang AND x.level = t.level AND x.place = xor(d.place >> t.level, 1) GROUP BY ALL
      UNION ALL SELECT row, depth + k.level, d.at >> k.level, max(x.h) FROM d, (SELECT DISTINCT level FROM u WHERE n > 1) AS k
        LEFT JOIN u AS x ON x.level = k.level AND x.place = xor(d.at >> k.level, 1) GROUP BY ALL),
q AS (SELECT row, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof FROM d LEFT JOIN s USING (row) GROUP BY row),
f AS (SELECT row, 0 AS level, now AS h FROM d
      UNION ALL SELECT f.row, f.level + 1, sha256(CASE WHEN s.own & 1 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END) FROM f JOIN s ON s.row = f.row AND s.level = f.level),
o AS (SELECT row, arg_max(h, level) AS folded_root FROM f GROUP BY row)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, proof AS proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM d JOIN q USING (row) JOIN o USING (row)
"""

QUERIES = {"op12_manifest": op12}
ORACLES = {"op12_manifest": SQL}
