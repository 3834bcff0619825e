"""Language ID against a plain backoff scorer, and the shares of large and small languages in the sample."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from pathloom.llm import language

SCHEMA = "doc_id long, text string, lang string"


def plain_model(rows):
    """Every word and n-gram of the learned rows, in plain dictionaries: {n: {key: {lang: times}}}."""
    counts = {n: {} for n in range(6)}
    for i, text, lang in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for word in regex.findall(r"\p{L}+", text.lower()):
            keys = [(0, word), *[(1, c) for c in word]]
            for n in range(2, 6):
                marked = f"^{word}$"
                keys += [(n, marked[k : k + n]) for k in range(len(marked) - n + 1)]
            for n, key in keys:
                by = counts[n].setdefault(key, {})
                by[lang] = by.get(lang, 0) + 1
    return counts


def plain_prediction(counts, text):
    langs = sorted({x for by in counts[0].values() for x in by})
    words = regex.findall(r"\p{L}+", (text or "").lower())
    if not words or not langs:
        return "und", 0.0
    total = {n: {x: sum(by.get(x, 0) for by in counts[n].values()) for x in langs} for n in counts}

    def log_frequency(n, key, lang):
        added = 0.1 if n == 0 else 0.5
        return math.log((counts[n][key].get(lang, 0) + added) / (total[n][lang] + added * (len(counts[n]) + 1)))

    score = dict.fromkeys(langs, 0.0)
    for word in words:
        found = [(0, word)] if word in counts[0] else []
        for n in range(5, 0, -1):
            if not found:
                marked = f"^{word}$" if n > 1 else word
                found = [(n, g) for k in range(len(marked) - n + 1) if (g := marked[k : k + n]) in counts[n]]
        for lang in langs if found else ():
            score[lang] += sum(log_frequency(n, key, lang) for n, key in found) / len(found)
    best = max(langs, key=lambda x: (score[x], -langs.index(x)))
    return best, 1 / sum(math.exp(max(-700, s - score[best])) for s in score.values())


def fixture():
    rng = np.random.default_rng(8)
    parts = {"aa": ["ka", "ro", "mi", "ß"], "bb": ["lu", "ré", "ka", "漢"], "cc": ["zo", "xi", "ta", "ro"]}
    rows = []
    for i in range(160):
        lang = str(rng.choice(list(parts)))
        words = ["".join(rng.choice(parts[lang], rng.integers(1, 6))) for _ in range(rng.integers(0, 25))]
        rows.append((i, " ".join(words) + " 12!", lang if i % 9 else None))
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "1 2 3", "cc"), (None, "ka ka mi", "aa"), (503, "x" * 20_000, "cc"), (504, "qq " * 50, "bb"), (504, "qq " * 50, "bb"), (505, "ŧŋđ", "aa")]
    return rows


@pytest.mark.parametrize("at_once", [language.WORDS_AT_ONCE, 7])
def test_every_prediction_equals_a_plain_backoff_scorer(spark, monkeypatch, at_once):
    monkeypatch.setattr(language, "WORDS_AT_ONCE", at_once)
    rows = fixture()
    counts = plain_model(rows)
    got = language.identified(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = Counter((i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, *plain_prediction(counts, t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.held_out, r.lang_pred) for r in got) == Counter(w[:3] for w in want.elements())
    for a, b in zip(sorted((repr(r.doc_id), r.score) for r in got), sorted((repr(w[0]), w[3]) for w in want.elements())):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


def test_nothing_learned_is_dropped(spark):
    rows = fixture()
    counts = plain_model(rows)
    langs, tables = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert langs == ["aa", "bb", "cc"]
    for n, (keys, starts, lang, _, _) in enumerate(tables):
        assert sorted(keys.tolist()) == sorted(language.hashes(counts[n]).tolist())
        assert len(lang) == starts[-1] == sum(map(len, counts[n].values()))


def test_small_language_keeps_documents_and_words(spark, monkeypatch):
    large = [(k, " ".join(f"gross{chr(97 + j)}" for j in range(20)), "big") for k in range(600)]
    small = [(1000 + k, "petit mot", "small") for k in range(20)]
    monkeypatch.setattr(language, "TRAIN", 60)
    langs, tables = language.learn(spark.createDataFrame(large + small, SCHEMA))
    assert langs == ["big", "small"] and len(tables[0][0]) == 22
    assert set(language.hashes(["petit", "mot"])) <= set(tables[0][0])


def test_many_languages_share_the_bound(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN", 20)
    rows = [(1000 * k + j, f"{chr(97 + k)}{chr(97 + j % 26)} w", f"l{k}") for k in range(8) for j in range(200)]
    langs, tables = language.learn(spark.createDataFrame(rows, SCHEMA))
    _, starts, lang, above, _ = tables[0]
    at = int(np.searchsorted(tables[0][0], language.hashes(["w"])[0]))
    documents = np.rint(np.expm1(above[starts[at] : starts[at + 1]]) * language.ADDED[0])
    assert len(langs) == 8 and 40 <= documents.sum() <= 120  # 4 * 20 documents of 8 languages, drawn by chance
