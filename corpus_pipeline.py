"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, BPE coding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents:
 language  drops documents without a language (`und`: no text or no letter);
 dedup     keeps one document of each SimHash group, the smallest doc_id;
 secrets   replaces each secret by a mark;
 mix       keeps each document as often as the mix of sources takes it;
 coding    encodes and decodes each text: tokens, hash of the ids, hash of the decoded text.

Defined results, stage by stage:
 language  a null or empty text, or one without a letter, goes; so do all rows if no row has a
           language to learn from; a null doc_id is never learned from, but stays if its text has a language;
 dedup     a text without words has fingerprint zero and forms groups like any other; of a group without any
           doc_id one row stays; of rows that repeat the kept doc_id and its fingerprint one stays;
 secrets   null texts, and rows without findings, stay as they are, n_chars too;
 mix       a row without words is taken as often as its source is taken whole; null is a source of its own;
 coding    a null text is encoded as the empty one: no tokens, the hash of nothing.
In all stages texts are read whole however long, repeated rows count as rows (but in dedup), ties go as
the operators' docstrings say, an empty table gives an empty table, and further columns pass
through under their names, whatever these are, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bpe, language, mixing, secrets, simhash
from pathloom.session import written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.spoken(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def coding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("dedup", dedup_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
    ("coding", coding_stage),
]

#: SQL expresses neither SimHash groups nor BPE; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
