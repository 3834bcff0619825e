"""Embedding near-duplicates by an exact metric range join.

Cosine >= c between vectors of one label is a chord of length <= r between their unit
vectors, r = sqrt(2 - 2c), and chords are a metric. A label with many vectors gets
sampled pivots; each vector lives in the cell of its nearest pivot. If u lives in cell j
and v within r of u lives elsewhere, the triangle inequality gives
    d(v, p_j) <= d(v, home of v) + 2r    and    d(v, p_j) <= radius of j + r,
so v is copied to every cell for which both hold. Then cells join independently: the
natives of a cell against its natives and copies find all their links. Every link is
so counted from both its ends, each in the end's home cell.

Equal vectors of a label are one class with a multiplicity, so copies never multiply.
A cell is dealt out in tiles: at most about BLOCK of its natives against at most about
BLOCK of its members (fewer if the vectors are long). A tile reports the number of links
of each native and a spanning set of links (each linked vector with the least one that
its links reach), not all pairs. There are at most PIVOTS pivots, whatever the input: the
cells grow, their tiles get more, and a tile doesn't grow.

In high dimensions vectors far from each other are nearly equally far from every
pivot, so singles are copied to most cells of their label; tight groups are not. A cell of h
natives and m members has h * m / BLOCK^2 tiles, so copies grow with h * m / BLOCK.

Defined results: rows with a null label or vec_id and vectors that are null, empty, zero or
hold null or non-finite components link with nothing (n_links 0, their own component, kept);
vectors of different dimension do not link; repeated rows are vectors of their own; a cosine
of 0.93 as doubles give it links, ties included; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.vectors import matrix, sound
from pathloom.operators.components import components
from pathloom.session import ship, written

COSINE, CELL, PIVOTS, BLOCK, SEED = 0.93, 4096, 8192, 4096, 11
#: Components that one side of a tile holds at most: a tile of long vectors has fewer of them.
COMPONENTS = 1 << 22
SLACK = 1e-7


def _scaled(column) -> np.ndarray:
    """The vectors, each by a power of two, which is exact, so that squares neither vanish nor overflow."""
    m = matrix(column)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, initial=0))[1][:, None]) if m.size else m


def _units(column) -> np.ndarray:
    m = _scaled(column)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _cells(pivots: dict, radius: float, radii: dict | None):
    """Batches (cid, grp, embedding, mult) -> their home cells with distances, or with radii: all their cells."""

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            rows, cells, far = [], [], []
            for g in np.unique(groups):
                own = np.flatnonzero(groups == g)
                if g not in pivots:
                    rows.append(own)
                    cells.append(np.zeros(len(own), np.int32))
                    far.append(np.zeros(len(own)))
                    continue
                for at in range(0, len(own), 1024):
                    some = own[at : at + 1024]
                    d = np.sqrt(np.maximum(0, 2 - 2 * (_units(batch.column("embedding").take(pa.array(some))) @ pivots[g].T)))
                    home = d.argmin(1)
                    if radii is None:
                        rows.append(some)
                        cells.append(home.astype(np.int32))
                        far.append(d.min(1))
                    else:
                        bound = np.minimum(d.min(1)[:, None] + 2 * radius, radii[g] + radius)
                        i, j = np.nonzero((d <= bound + SLACK) | (np.arange(d.shape[1]) == home[:, None]))
                        rows.append(some[i])
                        cells.append(j.astype(np.int32))
                        far.append(np.where(j == home[i], 0.0, 1.0))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(take) for c in ("cid", "grp", "embedding", "mult")]
                + [pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int32)), pa.array(np.concatenate(far) if far else np.zeros(0))],
                ["cid", "grp", "embedding", "mult", "cell", "far"],
            )

    return placed


def _joined(cosine: float):
    """One tile of a cell: a row (cid, n, root) for each native, and (cid, null, root) for linked members.

    n counts the tile's members that the native links with; a member that is the native itself counts
    as all its copies but one, a native that is no member here as none.
    """

    def join(block: pa.Table) -> pa.Table:
        # a class may be here as a native, as a member, or as both
        cid, first, place = np.unique(block["cid"].to_numpy(), return_index=True, return_inverse=True)
        m, mult = _scaled(block["embedding"].combine_chunks().take(pa.array(first))), block["mult"].to_numpy()[first]
        asks = block["native"].to_numpy()
        is_member = np.zeros(len(cid), bool)
        is_member[place[~asks]] = True
        native = np.unique(place[asks])
        mult = np.where(is_member, mult, 0)
        length = np.sqrt((m * m).sum(1))
        counts, root = np.zeros(len(native), np.int64), np.arange(len(cid))
        linked = []
        for at in range(0, len(cid), 4096):
            part = slice(at, min(at + 4096, len(cid)))
            near = (m[native] @ m[part].T) / (length[native][:, None] * length[None, part]) >= cosine
            near &= is_member[part]
            own = (native >= part.start) & (native < part.stop)
            near[np.flatnonzero(own), native[own] - part.start] = True
            counts += near @ mult[part]
            i, j = near.sum(1) > own, near.any(0)
            if i.any():
                linked.append((native[i], part.start + np.flatnonzero(j), near[np.ix_(i, j)]))
        while True:  # the least index that links reach, until nothing changes
            before = root.copy()
            for rows, cols, near in linked:
                root[rows] = np.minimum(root[rows], np.where(near, root[cols], len(cid)).min(1))
                root[cols] = np.minimum(root[cols], np.where(near, root[rows][:, None], len(cid)).min(0))
            if (before == root).all():
                break
        others = np.flatnonzero((root != np.arange(len(cid))) & ~np.isin(np.arange(len(cid)), native))
        return pa.table(
            {
                "cid": np.concatenate([cid[native], cid[others]]),
                "n": pa.concat_arrays([pa.array(counts - is_member[native]), pa.nulls(len(others), pa.int64())]),
                "root": np.concatenate([cid[root[native]], cid[root[others]]]),
            }
        )

    return join


def tiled(members: DataFrame) -> DataFrame:
    """members (grp, cell, cid, embedding, mult, native) dealt to tiles: once as natives that ask, once as members."""
    side = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(COMPONENTS) / F.max(F.size("embedding"))).cast("int")))
    cells = (
        members.groupBy("grp", "cell").agg(F.ceil(F.count_if("native") / side).cast("int").alias("blocks"), F.ceil(F.count("*") / side).cast("int").alias("tiles"))
        .where("blocks > 0")
    )
    dealt = (
        members.join(cells, ["grp", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .withColumn("tile", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("tiles")).cast("int"))
    )
    parts = ["grp", "cell", "block", "tile", "cid", "embedding", "mult"]
    asking = dealt.where("native").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*parts, F.lit(True).alias("native"))
    asked = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*parts, F.lit(False).alias("native"))
    return asking.unionByName(asked)


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table (vec_id, embedding, label)."""
    ship(table.sparkSession)
    # floats stay floats, half the bytes; any other number is a double
    kind = table.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = table.select("vec_id", "label", F.col("embedding").cast(kind).alias("embedding"))
    takes = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & sound(F.col("embedding"))
        & F.exists("embedding", lambda x: x != 0)
    )
    inside, outside = rows.where(takes), rows.where(~takes)
    classes = written(
        inside.groupBy("label", "embedding")
        .agg(F.count("*").alias("mult"), F.min("vec_id").alias("head"))
        .withColumn("cid", F.monotonically_increasing_id())
        .withColumn("grp", F.xxhash64("label", F.size("embedding"))),
        "classes",
    )
    radius = math.sqrt(2 - 2 * cosine)
    total = classes.count()
    size = max(CELL, -(-total // PIVOTS))
    # groups above one cell: at most PIVOTS of them
    large = classes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > size)
    drawn = F.shiftrightunsigned(F.xxhash64("embedding", F.lit(SEED)), 11) / F.lit(float(1 << 53)) < F.lit(1.0) / size
    sample = classes.join(F.broadcast(large), "grp").where(drawn).orderBy("cid").select("grp", "embedding").toArrow()
    pivots = {
        g: _units(sample.filter(pa.compute.equal(sample["grp"], g))["embedding"]) for g in set(sample["grp"].to_pylist())
    }
    shape = f"cid long, grp long, embedding {kind}, mult long, cell int, far double"
    columns = classes.select("cid", "grp", "embedding", "mult")
    radii: dict = {}
    if pivots:
        homes = columns.join(F.broadcast(large.select("grp")), "grp", "left_semi").select(*columns.columns).mapInArrow(_cells(pivots, radius, None), shape)
        held = {(r["grp"], r["cell"]): r["far"] for r in homes.groupBy("grp", "cell").agg(F.max("far").alias("far")).collect()}  # a row a pivot
        radii = {g: np.array([held.get((g, j), -1e9) for j in range(len(p))]) for g, p in pivots.items()}
    members = written(columns.mapInArrow(_cells(pivots, radius, radii), shape).withColumn("native", F.col("far") == 0), "members")
    found = written(
        tiled(members).groupBy("grp", "cell", "block", "tile").applyInArrow(_joined(cosine), "cid long, n long, root long"), "found"
    )
    counts = found.where("n is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    heads = classes.select("cid", "head").join(reached.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    joint = heads.groupBy("root").agg(F.min("head").alias("component_id"))
    named = (
        classes.join(heads.join(joint, "root").select("cid", "component_id"), "cid")
        .join(counts, "cid")
        .select(F.col("label").alias("l"), F.col("embedding").alias("e"), "component_id", "n")
    )
    one = inside.join(named, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select(
        "vec_id", F.col("n").alias("n_links"), "component_id"
    )
    none = outside.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.node, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON vec_id = a JOIN c ON vec_id = node
"""

QUERIES = {"op8_metric_join": op8}
ORACLES = {"op8_metric_join": SQL}
