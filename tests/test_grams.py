"""Trigrams of Arrow batches against plain Python, and the size of what a search state stores of them."""

import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.operators import grams
from pathloom.plans.stored import SearchState
from test_stored import big

TEXTS = ["abcd", "ab", None, "", "d:/a\U0001f600b\U0001f600", "文件名.pdf", "x" * 10]
ZONES, BLOCKS = [0, 0, 0, 0, 1, 1, 1], [5, 5, 6, 6, 7, 7, 8]


def cut(text):
    return {text[i : i + 3] for i in range(len(text or "") - 2)}


def test_postings_are_those_of_plain_cutting():
    batch = pa.RecordBatch.from_arrays([pa.array(ZONES, pa.int32()), pa.array(BLOCKS, pa.int64()), pa.array(TEXTS)], ["zone", "block", "text"])
    want = {(g, z): set() for z, t in zip(ZONES, TEXTS) for g in cut(t)}
    for z, b, t in zip(ZONES, BLOCKS, TEXTS):
        for g in cut(t):
            want[g, z].add(b)
    for batches in ([batch], [batch.slice(0, 3), batch.slice(3)]):
        rows = [r for out in grams.postings(batches) for r in out.to_pylist()]
        assert {(r["gram"], r["zone"]): set(r["blocks"]) for r in rows} == want and len(rows) == len(want)


def test_bits_of_a_text_are_those_of_its_trigrams():
    found = grams.bits(pa.array(["left out", *TEXTS]).slice(1)).to_pylist()
    assert [(b["low"], b["high"]) for b in found] == [grams.bits_of(sorted(cut(t))) for t in TEXTS]


def test_a_state_stores_a_trigram_once_a_zone(spark, tmp_path):
    state = SearchState(spark, str(tmp_path / "s"), zone=128)
    state.save(big(spark), 1)
    stored = state.view()._rows("postings")
    assert stored.count() == stored.select("gram", "zone").distinct().count()
    assert state.matches("file19 txt", indexed=True).count() == state.matches("file19 txt").count() > 0
    assert stored.agg(F.max(F.size("blocks"))).first()[0] <= 2
