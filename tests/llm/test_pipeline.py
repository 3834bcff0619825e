"""The pipeline stage by stage against plain versions, and the entry points."""

import hashlib
from collections import Counter

import public_tokenizers

import __spark_entry__
import corpus_pipeline
from test_documents import plain_print, plain_spans  # the same folder


def test_pipeline_against_plain_versions(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    spoken = {r.doc_id: r for r in corpus_pipeline.language_stage(spark, docs, tables).collect()}
    assert set(spoken) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(list(spoken.values()), docs.schema), tables)
    prints = {i: plain_print(r.text) for i, r in spoken.items()}
    ids = sorted(prints)
    root = {}
    for i in ids:  # breadth first from the smallest id of each group
        if i not in root:
            todo = [i]
            while todo:
                a = todo.pop()
                root[a] = i
                todo += [b for b in ids if b not in root and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {r.doc_id for r in kept.collect()} == set(root.values())
    clean = corpus_pipeline.secrets_stage(spark, kept, tables)
    assert clean.columns == docs.columns and not any(plain_spans(r.text) for r in clean.collect())
    mixed = corpus_pipeline.mix_stage(spark, clean, tables)
    assert mixed.columns == docs.columns
    final = Counter(map(tuple, corpus_pipeline.run(spark, tables).collect()))

    def coded(text):
        found = library.encode(text, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(found), sha(" ".join(map(str, found))), sha(library.decode(found, skip_special_tokens=False))

    assert final == Counter((r.doc_id, *coded(r.text)) for r in mixed.collect())


def test_every_dealt_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
