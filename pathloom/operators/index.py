"""An optional index of path words: trigram postings and bit signatures of blocks of rows.

Blocks are stretches of 64 ids. A query's trigrams give candidate blocks, and signatures
thin them; the exact predicate then decides, so an index never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.names import trigrams
from pathloom.functions.query import Query, parse, path_predicate

BLOCK = 64


def block_of(identity: Column) -> Column:
    return F.floor(identity / BLOCK).cast("long")


def _searched(path: Column) -> Column:
    folded = F.lower(path)
    return F.when(F.contains(folded, F.lit("/")), folded).otherwise(F.concat(F.lit("/"), folded))


def postings(rows: DataFrame) -> DataFrame:
    """(gram, block) for rows (id, path): each trigram of a block once."""
    return rows.select(block_of(F.col("id")).alias("block"), F.explode(trigrams(_searched(F.col("path")))).alias("gram")).distinct()


def gram_bits(grams: Column) -> Column:
    """Two of 64 bits for each gram, joined: what contains a gram has its bits."""
    def bits(g: Column) -> Column:
        h = F.xxhash64(g)
        one = F.lit(1).cast("long")
        low, high = h.bitwiseAND(F.lit(63)).cast("int"), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))

    return F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a.bitwiseOR(bits(g)))


def short_grams(text: Column) -> Column:
    """Single characters and pairs, for words too short for trigrams."""
    pairs = F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    )
    return F.array_distinct(F.concat(F.split(text, ""), pairs))


def signatures(rows: DataFrame) -> DataFrame:
    """(block, sig): the bits of all characters and pairs of a block's paths."""
    one = gram_bits(short_grams(_searched(F.col("path"))))
    return rows.groupBy(block_of(F.col("id")).alias("block")).agg(F.bit_or(one).alias("sig"))


def candidate_blocks(index: DataFrame, query: Query) -> DataFrame | None:
    """(block): blocks that have every trigram of the query's words; None if it has none."""
    grams = sorted({t[i : i + 3] for t in query.tokens for i in range(len(t) - 2)})
    if not grams:
        return None
    found = index.where(F.col("gram").isin(grams)).groupBy("block").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(grams)).select("block")


def record_bits(grams: Column) -> Column:
    """One of 128 bits for each gram, as (low, high): what contains the grams has their bits."""
    places = F.transform(grams, lambda g: F.xxhash64(g).bitwiseAND(F.lit(127)).cast("int"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def half(p: Column, low: bool) -> Column:
        def add(bits: Column, place: Column) -> Column:
            return F.when((place < 64) == F.lit(low), bits.bitwiseOR(F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63))))).otherwise(bits)

        return F.aggregate(p, none, add)

    return F.get(F.transform(F.array(places), lambda p: F.struct(half(p, True).alias("low"), half(p, False).alias("high"))), F.lit(0))


def record_signatures(rows: DataFrame) -> DataFrame:
    """rows (id, path) with sig: the 128 bits of each row's own trigrams."""
    return rows.withColumn("sig", record_bits(trigrams(_searched(F.col("path")))))


def signed_search(rows: DataFrame, raw: str) -> DataFrame:
    """The rows (id, path, sig) that a dialect A query matches; a row without the bits of the words is never searched."""
    query = parse(raw, "A")
    grams = sorted({t[i : i + 3] for t in query.tokens for i in range(len(t) - 2)})
    if grams:
        need = record_bits(F.array(*map(F.lit, grams)))
        has = [F.col("sig")[part].bitwiseAND(need[part]) == need[part] for part in ("low", "high")]
        rows = rows.where(has[0] & has[1])
    return rows.where(path_predicate(query, F.col("path"))).select("id", "path")


def indexed_search(rows: DataFrame, index: DataFrame, sigs: DataFrame, raw: str) -> DataFrame:
    """The rows (id, path) that a dialect A query matches, by way of the index."""
    query = parse(raw, "A")
    blocked = rows.withColumn("block", block_of(F.col("id")))
    blocks = candidate_blocks(index, query)
    short = [t for t in query.tokens if 0 < len(t) < 3]
    if short:
        need = gram_bits(F.array(*[F.lit(g) for t in short for g in {*t, t}]))
        fits = sigs.where(F.col("sig").bitwiseAND(need) == need).select("block")
        blocks = fits if blocks is None else blocks.join(fits, "block", "left_semi")
    if blocks is not None:
        blocked = blocked.join(blocks, "block", "left_semi")
    return blocked.where(path_predicate(query, F.col("path"))).select("id", "path")
