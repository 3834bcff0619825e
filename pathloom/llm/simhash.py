"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint has 64 bits in RING segments on a ring. If two fingerprints differ in
at most T bits, some start on the ring has every chain of k consecutive segments
differ in at most floor(k * T / RING) bits (the cycle lemma). With eight segments
and T = 3 the budgets are 0 0 1 1 1 2 2 3: from that start two segments agree, and
of the next three at most one differs, by one bit. So each fingerprint is filed under
24 keys (8 starts, one of three segments left out): four segments, 32 bits. Pairs that
share a key are candidates, then pass the chain test, then the full Hamming test.

Size: a fingerprint is filed 24 times, 16 bytes each. A key has 32 bits, so among n different
fingerprints about 24 * n / 2^32 unrelated ones share a key with each: 56 at 10^10 classes. Each
costs one comparison inside a task's block.

Defined results:
 * null or blank text: no words, fingerprint zero, linked like any other fingerprint;
 * fewer than three words: the one shingle is the whole sequence;
 * very long texts are read whole, their shingles in parts of 65,536;
 * a bit set in exactly half of the shingles is 0;
 * equal fingerprints form one class, whatever their number: classes, not documents,
   are compared, so copies never multiply;
 * repeated rows appear as often as they do in the input;
 * a null doc_id takes part but never names a component; a component of nulls has a null id
   (deduplication then keeps one row of it);
 * an empty table gives no rows; further columns are ignored (or kept, by one_of_each(),
   whatever their names).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.rows import runs, small, texts
from pathloom.operators.components import components
from pathloom.session import ship, spread, written

RING, WIDTH, MOST = 8, 8, 3
#: The largest number of classes under one key that one task compares.
BLOCK = 2048
SHINGLE, SEED = 3, 42


def budgets(ring: int = RING, most: int = MOST) -> list[int]:
    """The bits in which chains of 1, 2, ... segments may differ."""
    return [k * most // ring for k in range(1, ring + 1)]


def masks() -> list[tuple[int, int]]:
    """(bits of the key, bits left out) for each of the keys, from the budgets.

    A key covers the longest chain with a budget of at most one bit and leaves out one
    of the segments in which that bit may lie.
    """
    allowed = budgets()
    chain = sum(b <= 1 for b in allowed)
    free = [k for k in range(chain) if allowed[k] == 1]
    out = []
    for start in range(RING):
        for gap in free:
            bits = [(start + k) % RING for k in range(chain) if k != gap]
            out.append(
                (
                    sum(((1 << WIDTH) - 1) << (WIDTH * s) for s in bits),
                    ((1 << WIDTH) - 1) << (WIDTH * ((start + gap) % RING)),
                )
            )
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    count, total = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k : len(part) - shingle + 1 + k] for k in range(shingle))))
        h = np.fromiter((digest(g, seed) for g in grams), np.uint64, len(part) - shingle + 1)
        count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, "text"):
        fp = np.fromiter((fingerprint(t) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of candidates, links that connect what is within MOST bits: a forest, not all pairs."""
    left_out = np.array([gap for _, gap in masks()], np.uint64)
    for table, starts in runs(batches, ["pos", "v", "i", "j"]):
        fp, pos = table.column("fp").to_numpy().view(np.uint64), table.column("pos").to_numpy()
        a, b = [], []
        two = np.flatnonzero(np.diff(starts) == 2)
        x, y, gap = fp[starts[two]], fp[starts[two] + 1], left_out[pos[starts[two]]]
        near = (np.bitwise_count((x ^ y) & gap) <= 1) & (np.bitwise_count(x ^ y) <= MOST)
        a.append(x[near])
        b.append(y[near])
        for k in np.flatnonzero(np.diff(starts) > 2):
            rest, gap = fp[starts[k] : starts[k + 1]], left_out[pos[starts[k]]]
            while len(rest) > 1:
                queue, rest = [rest[0]], rest[1:]
                while queue and len(rest):
                    d = rest ^ queue.pop()
                    near = np.bitwise_count(d & gap) <= 1
                    near[near] = np.bitwise_count(d[near]) <= MOST
                    if near.any():
                        found = rest[near]
                        a.append(found)
                        b.append(found ^ d[near])
                        queue.extend(found)
                        rest = rest[~near]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"]
        )


def near_links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between fingerprints (column fp, all different) at MOST bits or fewer.

    Enough links to connect all that the full set connects. Keys that more than `block`
    classes share are dealt out over pairs of blocks, so no task gets a whole hot key.
    """
    ship(classes.sparkSession)
    filed = classes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m, _ in masks()])).alias("pos", "v")
    )
    live = written(filed.groupBy("pos", "v").agg(F.count("*").alias("n")).where("n > 1"), "live-keys")
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        filed.join(live, ["pos", "v"])
        .withColumn("parts", parts)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn(
            "other",
            F.explode(
                F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
                    F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine"))
                )
            ),
        )
        .select("pos", "v", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )
    return (
        dealt.repartition("pos", "v", "i", "j")
        .sortWithinPartitions("pos", "v", "i", "j")
        .mapInArrow(_linked, "a long, b long")
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) for each row of docs (doc_id, text); root is a fingerprint of the component."""
    ship(docs.sparkSession)
    prints = written(spread(docs.select("doc_id", "text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "classes")
    reached = components(near_links(classes.select("fp"))).withColumnRenamed("node", "fp")
    linked = written(classes.join(reached, "fp"), "linked")
    heads = linked.groupBy("root").agg(F.min("head").alias("joint"))
    named = classes.join(linked.join(heads, "root").select("fp", "root", "joint"), "fp", "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("joint", "head").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return prints.join(named, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: the one whose doc_id names it; of a component without ids, any one.

    A doc_id may be repeated with other texts, so rows are then chosen by doc_id and fingerprint.
    The columns of docs travel as one struct, so their names meet no other.
    """
    found = written(near_duplicates(docs), "components")
    keep = written(
        found.where("doc_id is not null").groupBy(F.col("doc_id").alias("kept_id"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("component_id") == F.col("doc_id")).alias("names")).where("names > 0"), "kept"
    )
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            fp = np.fromiter((fingerprint(t) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])

    with_fp = T.StructType([rows.schema["doc_id"], rows.schema["row"], T.StructField("fp", T.LongType())])
    several = F.col("n") > 1

    def of(kept: DataFrame) -> DataFrame:
        return rows.join(kept.select("kept_id"), F.col("doc_id") == F.col("kept_id"), "left_semi")

    if keep.where(several).head(1):
        named = found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("named"), "root").agg(F.min("fp").alias("chosen"))
        exact = of(keep.where(several)).mapInArrow(marked, with_fp).join(
            named.select("named", "chosen"), (F.col("doc_id") == F.col("named")) & (F.col("fp") == F.col("chosen")), "left_semi"
        )
        out = of(keep.where(~several)).select("row").unionByName(exact.dropDuplicates(["doc_id", "fp"]).select("row"))
    else:
        out = of(keep).select("row")
    if found.where("doc_id is null and component_id is null").head(1):
        chosen = found.where("component_id is null").groupBy("root").agg(F.min("fp").alias("chosen")).select("chosen")
        nameless = rows.where("doc_id is null").mapInArrow(marked, with_fp)
        out = out.unionByName(nameless.join(chosen, F.col("fp") == F.col("chosen"), "left_semi").dropDuplicates(["fp"]).select("row"))
    return out.select("row.*")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op4_simhash": op4}
ORACLES: dict = {}
