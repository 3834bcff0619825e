"""Documents whose doc_id is repeated with another text."""

from pathloom.llm import simhash

A, B, C = (" ".join(f"{w}{k * k % 101}" for k in range(60)) for w in ("alpha", "beta", "gamma"))
SCHEMA = "doc_id long, text string, lang string, source string"


def kept(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())


def test_one_id_names_two_groups(spark):
    assert kept(spark, [(1, A), (1, B), (2, A), (3, B), (4, C)]) == sorted([(1, A), (1, B), (4, C)])


def test_an_id_names_one_group_and_is_in_another(spark):
    assert kept(spark, [(5, C), (5, C), (5, B), (2, B), (7, A)]) == sorted([(5, C), (2, B), (7, A)])
