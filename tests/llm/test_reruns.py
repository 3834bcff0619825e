"""Reruns of the mix over other layouts of rows that share doc_id and size, and the bound of bytes that languages are learned from."""

from collections import Counter

from pathloom.llm import language, mixing

SCHEMA = "doc_id long, source string, text string, tie string"


def test_layouts_of_tied_rows_give_one_mix(spark):
    rows = [(7, "s", f"word{k:02d}", f"t{k}") for k in range(40)] + [(k, "t", "a b c", "x") for k in range(30)]
    found = [Counter(map(tuple, mixing.mixed(spark.createDataFrame(rows[k:] + rows[:k], SCHEMA).repartition(k % 5 + 1)).collect())) for k in (0, 3, 17, 29)]
    assert all(f == found[0] for f in found) and found[0]


def test_long_documents_bound_what_is_learned(spark, monkeypatch):
    rows = [(k, f"{'abcdefgh'[k % 8]}word " * 400, "en" if k % 2 else "de") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, tables = language.learn(docs)
    monkeypatch.setattr(language, "TRAIN_BYTES", 20_000)
    few, less = language.learn(docs)
    assert langs == few == ["de", "en"]
    counted = lambda t: sum(len(x[2]) for x in t)
    assert 0 < counted(less) <= counted(tables)
