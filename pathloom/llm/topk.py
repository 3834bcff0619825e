"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are integers. The K best scores among the SEEDS longest vectors give each query a
first threshold. Queries then meet the other vectors in tiles, blocks of at most about BLOCK
queries against chunks of at most about CHUNK vectors. Queries are blocked by their need, the
least length with which a vector can enter (threshold / |q|), so a vector goes to a block only if
its length reaches the least need there (score <= |q| * |v|). In a tile the vectors are taken
in buckets of like length, the longest first. With t = threshold / (|q| * longest of the
bucket), the local cosine threshold, each query and bucket choose their pruning:
 * t > 1: nothing in this or a later bucket can enter; the query is done;
 * t >= COSINE: coordinates. A unit vector with cosine t to the unit query has each
   coordinate x with |x - t * q| <= sqrt((1 - t * t) * (1 - q * q)) or closer to q; tested on
   the query's FOCUS largest coordinates;
 * else length: the vectors with length >= threshold / |q|, a prefix of the bucket.
Products of what is left are computed, and thresholds rise. Bounds have a slack of 1e-9
relative, far more than their rounding; ties at a threshold are always kept.

Products are exact: in doubles where |q| * |v| * dimension stays below 2^53, else in 64-bit
integers below 2^62, else in Python's.

Size: a query's row is copied once for each chunk and a vector's once for each block that it
may enter, so both copies and products grow with the square of the table, as do the scores that
are asked for; a tile does not grow. What is broadcast is one row a dimension with STEPS
classes of need at most, and SEEDS vectors.

Defined results: rows with a null vec_id and vectors that are null, empty or hold null or
non-finite components take no part; only vectors of one dimension are compared; a zero
query scores 0 with all; each row is a candidate and a query of its own, also where a vec_id
repeats (a query then has other rows of its own vec_id as candidates, and its ranks come once
for each of its rows); ties go to smaller ids; components and scores beyond a long are its
least or largest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.vectors import matrix, sound
from pathloom.session import ship, written

K, EVERY, SCALE = 20, 20, 64
SEEDS, BLOCK, CHUNK, STEPS, BUCKET, COSINE, FOCUS = 4096, 4096, 16384, 64, 512, 0.6, 4
SLACK = 1e-9
LOW, LEAST, MOST = -(1 << 62), -(1 << 63), (1 << 63) - 1


class Product:
    """Exact inner products of integer rows, in the cheapest arithmetic that is exact for two tables."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        # in Python's integers: the least long has no absolute value among longs
        most = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
        bound = most[0] * most[1] * max(1, a.shape[1])
        self.kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        self.a, self.b = a.astype(self.kind), b.astype(self.kind)

    def __call__(self, rows, columns) -> np.ndarray:
        """Scores of some rows of a with some rows of b."""
        found = self.a[rows] @ self.b[columns].T
        if self.kind is object:
            found = np.clip(found, LEAST, MOST)
        return found.astype(np.int64)


class Best:
    """The K best (score, id) of one query so far; threshold: the lowest score that still enters."""

    __slots__ = ("scores", "ids", "threshold")

    def __init__(self, threshold: int):
        self.scores, self.ids, self.threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), threshold

    def add(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        enter = scores >= self.threshold
        if not enter.any():
            return
        scores, ids = np.concatenate([self.scores, scores[enter]]), np.concatenate([self.ids, ids[enter]])
        order = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round and knows no overflow
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == k:
            self.threshold = max(self.threshold, int(self.scores[-1]))


def block_best(q: np.ndarray, q_rows: np.ndarray, thresholds: np.ndarray, v: np.ndarray, v_ids: np.ndarray, v_rows: np.ndarray, k: int) -> list[Best]:
    """The best of the vectors v for each query q, by buckets of falling length; a row is no candidate of its own."""
    best = [Best(int(t)) for t in thresholds]
    q_len, v_len = (np.sqrt((x.astype(np.float64) ** 2).sum(1)) for x in (q, v))
    order = np.lexsort((v_ids, -v_len))
    v, v_ids, v_rows, v_len = v[order], v_ids[order], v_rows[order], v_len[order]
    product = Product(q, v)
    q_unit = q / np.maximum(q_len, 1)[:, None]
    focus = np.argsort(-np.abs(q_unit), axis=1)[:, :FOCUS]
    going = np.arange(len(q))
    for at in range(0, len(v), BUCKET):
        part = slice(at, min(at + BUCKET, len(v)))
        ids, rows, length = v_ids[part], v_rows[part], v_len[part]
        t = np.array([best[i].threshold for i in going], float)
        reach = q_len[going] * length[0]
        local = np.divide(t, reach, out=np.full(len(going), -1.0), where=(reach > 0) & (t > 0))
        stay = ~((local > 1 + SLACK) | ((reach == 0) & (t > 0)))
        going, local = going[stay], local[stay]
        if not len(going):
            break
        by_coordinate = local >= COSINE
        unit = v[part] / np.maximum(length, 1e-300)[:, None] if by_coordinate.any() else None
        for i, t in zip(going[by_coordinate], local[by_coordinate]):
            # the local threshold of the bucket holds for all: shorter vectors need more
            t = min(t, 1.0) * (1 - SLACK)
            keep = rows != q_rows[i]
            for f in focus[i]:
                x = q_unit[i, f]
                away = math.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + SLACK
                low = -1.0 if x <= -t else x * t - away
                high = 1.0 if x >= t else x * t + away
                keep &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
            kept = np.flatnonzero(keep)
            if len(kept):
                best[i].add(product(slice(i, i + 1), at + kept)[0], ids[kept], k)
        rest = going[~by_coordinate]
        for some in np.array_split(rest, max(1, -(-len(rest) // 1024))):
            if not len(some):
                continue
            products = product(some, part)
            for row, i in enumerate(some):
                stop = len(ids)
                if q_len[i] > 0 and best[i].threshold > 0:
                    stop = int(np.searchsorted(-length, -(best[i].threshold / q_len[i]) * (1 - SLACK), side="right"))
                other = rows[:stop] != q_rows[i]
                best[i].add(products[row, :stop][other], ids[:stop][other], k)
    return best


def tiles(v: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, placed): queries and vectors dealt to tiles (dim, class, block, chunk).

    v (vec_id, row, dim, length, v); queries (query_id, q_row, dim, v, threshold, need).
    """
    # classes of like need in each dimension, and their blocks
    most = F.least(F.lit(STEPS), F.ceil(F.col("n") / BLOCK)).cast("int")  # no more classes than blocks are needed
    cuts = queries.groupBy("dim").agg(F.percentile_approx("need", [j / STEPS for j in range(1, STEPS)], 1000).alias("cuts"), F.count("*").alias("n"))
    chosen = F.transform(F.slice(F.sequence(F.lit(0), most), F.lit(2), most - 1), lambda j: F.get("cuts", F.floor(j * STEPS / most).cast("int") - 1))
    cuts = cuts.select("dim", F.array_distinct(chosen).alias("cuts"))
    classed = queries.join(cuts, "dim").withColumn("class", F.size(F.filter("cuts", lambda c: c < F.col("need")))).drop("cuts", "length")
    classes = classed.groupBy("dim", "class").agg(F.min("need").alias("need"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    reach = classes.groupBy("dim").agg(F.collect_list(F.struct("need", "class", "blocks")).alias("classes"))  # STEPS at most
    chunks = v.groupBy("dim").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    blocks = F.flatten(
        F.transform(
            F.filter("classes", lambda c: c["need"] <= F.col("length")),
            lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda b: F.struct(c["class"].alias("class"), b.alias("block"))),
        )
    )
    placed = (
        v.join(reach, "dim").join(chunks, "dim")
        .withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.col("chunks")).cast("int"))
        .withColumn("met", F.explode(blocks))
        .select("dim", "met.class", "met.block", "chunk", "vec_id", "row", "v")
    )
    asked = (
        classed.join(classes.select("dim", "class", "blocks"), ["dim", "class"]).join(chunks, "dim")
        .withColumn("block", F.pmod(F.xxhash64("q_row"), F.col("blocks")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("dim", "class", "block", "chunk", "query_id", "q_row", "v", "threshold")
    )
    return asked, placed


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for each row whose vec_id is divisible by `every`."""
    ship(table.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    v = written(
        table.select("vec_id", "embedding").where(sound(F.col("embedding")) & F.col("vec_id").isNotNull())
        .select("vec_id", whole.alias("v"), F.monotonically_increasing_id().alias("row")),
        "vectors",
    )
    ends = v.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    kind = "array<int>" if ends[0] is not None and ends[0] >= -(1 << 31) and ends[1] < 1 << 31 else "array<long>"
    v = v.withColumn("v", F.col("v").cast(kind))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.withColumn("dim", F.size("v")).withColumn("length", F.sqrt(square))
    seeds = v.orderBy(F.desc("length"), "row").limit(SEEDS).toArrow()  # SEEDS rows at most
    by_dim = {
        d: (matrix((part := seeds.filter(pa.compute.equal(seeds["dim"], d)))["v"], np.int64), part["row"].to_numpy())
        for d in set(seeds["dim"].to_pylist())
    }

    def first_thresholds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, LOW, np.int64)
            dims, rows = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            for d in set(dims.tolist()) & set(by_dim):
                own = np.flatnonzero(dims == d)
                m, m_rows = by_dim[d]
                if len(m) <= k:
                    continue
                for at in range(0, len(own), 256):
                    some = own[at : at + 256]
                    s = Product(matrix(batch.column("v").take(pa.array(some)), np.int64), m)(slice(None), slice(None))
                    s[rows[some][:, None] == m_rows] = LEAST
                    out[some] = np.partition(s, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "row", "dim", "length", "v")] + [pa.array(out)],
                ["query_id", "q_row", "dim", "length", "v", "threshold"],
            )

    need = F.when((F.col("threshold") <= 0) | (F.col("length") == 0), 0.0).otherwise(F.col("threshold") / F.col("length") * (1 - SLACK))
    queries = written(
        v.where(F.col("vec_id") % every == 0)
        .mapInArrow(first_thresholds, f"query_id long, q_row long, dim int, length double, v {kind}, threshold long")
        .withColumn("need", need),
        "queries",
    )
    asked, placed = tiles(v, queries)

    def met(asked: pa.Table, placed: pa.Table) -> pa.Table:
        found: list[Best] = []
        q_ids, q_rows = asked["query_id"].to_numpy(), asked["q_row"].to_numpy()
        if len(q_ids) and placed.num_rows:
            found = block_best(
                matrix(asked["v"], np.int64), q_rows, asked["threshold"].to_numpy(),
                matrix(placed["v"], np.int64), placed["vec_id"].to_numpy(), placed["row"].to_numpy(), k,
            )
        n = [len(b.ids) for b in found] if found else [0] * len(q_ids)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table(
            {
                "q_row": np.repeat(q_rows, n),
                "query_id": np.repeat(q_ids, n),
                "vec_id": join([b.ids for b in found]),
                "score": join([b.scores for b in found]),
            }
        )

    keys = ["dim", "class", "block", "chunk"]
    some = asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(met, "q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")).cast("int")
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op10_topk": op10}
ORACLES = {"op10_topk": SQL}
