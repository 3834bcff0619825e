"""Language identification: word-first backoff.

Words are stretches of letters, in lower case. A known word scores its log frequency in
each language. An unseen word falls back to the longest of its character n-grams, five
to one, that are known in any language (with marks for the word's ends), scored by the
mean of their log frequencies. A text's score is the sum over its words; the posterior of
the best language, with equal priors, is the reported score.

The model is learned from about TRAIN documents of each language, a seeded share of all
that may be learned from, and at most about TRAIN_BYTES of its text; beyond LANGS languages, they
share LANGS times as much. These bounds on the sample are the only ones: every word and every n-gram of the sampled documents is in the
model, however rare or long. Words are counted once, n-grams from distinct words, both
distributed; keys are held by their 64-bit hashes and counts sparsely (only for languages that
have the key), about 14 bytes each, on the driver and in each worker.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing
could be learned; a text with no known n-gram at all gets the first language with an even
score, and equal best languages the first by name; very long texts are read whole, WORDS_AT_ONCE
words at a time; documents without a doc_id are predicted, never learned from, and
count as held out; repeated rows are kept; an empty table gives no rows; further columns are
ignored (or kept, by spoken(), whatever their names).
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Collection, Iterable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.memo import once
from pathloom.llm.rows import small
from pathloom.session import ship, spread, written

TRAIN, ORDER, FOLDS, HELD, LANGS = 10_000, 5, 5, 0, 4
#: So many bytes of a language are learned from, about, however long its documents are.
TRAIN_BYTES = TRAIN << 14
#: What is added to every count: of words, and of n-grams.
ADDED = (0.1, 0.5)
#: So many words are scored together; their number bounds what a worker holds beside the model.
WORDS_AT_ONCE = 200_000
#: So many languages at most have their numbers broadcast; with more, texts are shuffled by language.
MOST_BROADCAST = 100_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> Iterator[list[str]]:
    """The words of a text, in lists of at most WORDS_AT_ONCE."""
    found = (m[0] for m in _LETTERS.finditer((text or "").lower()))
    while words := list(islice(found, WORDS_AT_ONCE)):
        yield words


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with an end mark on both sides."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def hashes(keys: Collection[str]) -> np.ndarray:
    """The 64 bits by which each word or n-gram is known, as signed numbers."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(k.encode("utf-8", "surrogatepass"), 42) for k in keys), np.uint64, len(keys)).view(np.int64)


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, word, times)."""
    for batch in small(batches, "text", 4 << 20):
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for words in words_of(text):
                by_lang[lang].update(words)
        langs = [lang for lang, words in by_lang.items() for _ in words]
        keys = [w for words in by_lang.values() for w in words]
        times = [c for words in by_lang.values() for c in words.values()]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "times"])


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, n, key, times) of distinct words (n = 0) and of their n-grams, by hash."""
    for batch in small(batches, "word", 1 << 18):
        tables: dict[tuple, Counter] = defaultdict(Counter)
        for lang, word, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "times"))):
            tables[lang, 0][word] += times
            for n in range(1, ORDER + 1):
                table = tables[lang, n]
                for g in grams(word, n):
                    table[g] += times
        langs = [lang for (lang, _), t in tables.items() for _ in t]
        orders = [n for (_, n), t in tables.items() for _ in t]
        keys = np.concatenate([hashes(t) for t in tables.values()]) if tables else np.zeros(0, np.int64)
        times_ = [c for t in tables.values() for c in t.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(orders, pa.int32()), pa.array(keys, pa.int64()), pa.array(times_, pa.int64())],
            ["lang", "n", "key", "times"],
        )


class Model:
    """Log frequencies by language.

    Of each length n (0: words): the sorted hashes of its keys; where each one's entries start; of
    each entry the language and how far its log frequency is above that of an unseen key; and
    the log frequency of an unseen key in each language.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def _add(self, out: np.ndarray, n: int, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Adds to the rows `owner` of out the mean over their known keys; returns the owners with one."""
        have, starts, lang, above, unseen = self.tables[n]
        if not len(have):
            return owner[:0]
        at = np.searchsorted(have, keys)
        hit = have[np.minimum(at, len(have) - 1)] == keys
        owner, at = owner[hit], at[hit]
        of_each = np.bincount(owner, minlength=len(out))
        size = starts[at + 1] - starts[at]
        entry = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[at], size)
        owner = np.repeat(owner, size)
        wide = len(self.langs)
        out += np.bincount(owner * wide + lang[entry], above[entry] / of_each[owner], out.size).reshape(out.shape)
        found = np.flatnonzero(of_each)
        out[found] += unseen
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """The score of each word in each language: its own, or the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        left = np.arange(len(words))
        for n in (0, *range(ORDER, 0, -1)):
            keys = [[words[k]] if n == 0 else grams(words[k], n) for k in left]
            owner = np.repeat(left, [len(x) for x in keys])
            left = np.setdiff1d(left, self._add(out, n, owner, hashes([g for x in keys for g in x])), assume_unique=True)
            if not len(left):
                break
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; the words of WORDS_AT_ONCE are scored together."""
        total, wordy = np.zeros((len(texts), max(1, len(self.langs)))), np.zeros(len(texts), bool)
        place: dict[str, int] = defaultdict(count().__next__)
        owners: list[int] = []
        at: list[int] = []

        def told() -> None:
            nonlocal place
            own = np.array(owners, np.int64)
            wordy[own] = True
            if self.langs:
                score = self.scores(list(place))[at]
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(own, score[:, k], len(texts))
            owners.clear()
            at.clear()
            place = defaultdict(count().__next__)

        for k, text in enumerate(texts):
            for words in words_of(text):
                at += map(place.__getitem__, words)
                owners += [k] * len(words)
                if len(at) >= WORDS_AT_ONCE:
                    told()
        if at:
            told()
        best = total.argmax(1)
        share = 1 / np.exp(np.maximum(total - total.max(1)[:, None], -700)).sum(1)
        return [(self.langs[b], float(x)) if w and self.langs else (UNKNOWN, 0.0) for b, x, w in zip(best, share, wordy)]


def learn(docs: DataFrame, seed: int = 5) -> tuple[list[str], list[tuple]]:
    """The parts of a Model from docs (doc_id, text, lang) of the folds that may be learned from."""
    ship(docs.sparkSession)
    may = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD)
    ).select("doc_id", "lang", "text")
    there = may.groupBy("lang").agg(F.count("*").alias("there"), F.sum(F.octet_length("text")).alias("bytes"))
    langs = there.count()
    share = LANGS / max(LANGS, langs)
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53)) < F.least(F.lit(TRAIN * share) / F.col("there"), F.lit(TRAIN_BYTES * share) / F.greatest(F.col("bytes"), F.lit(1)))
    there = F.broadcast(there) if langs <= MOST_BROADCAST else there
    sample = spread(may).join(there, "lang").where(drawn).select("lang", "text")
    counted = written(sample.mapInArrow(_words, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times")), "words")
    keyed = spread(counted).mapInArrow(_keys, "lang string, n int, key long, times long").groupBy("n", "key", "lang").agg(F.sum("times").alias("times"))
    rows = keyed.toArrow()  # bounded as the sample is
    langs = sorted(rows["lang"].unique().to_pylist())
    of_lang = pa.compute.index_in(rows["lang"], pa.array(langs, pa.string())).to_numpy().astype(np.int32)
    of_n, of_key, of_times = (rows[c].to_numpy() for c in ("n", "key", "times"))
    tables = []
    for n in range(ORDER + 1):
        own = np.flatnonzero(of_n == n)
        own = own[np.lexsort((of_lang[own], of_key[own]))]
        lang, times = of_lang[own], of_times[own]
        keys, starts = np.unique(of_key[own], return_index=True)
        added = ADDED[min(n, 1)]
        unseen = np.log(added) - np.log(np.bincount(lang, times, len(langs)) + added * (len(keys) + 1))
        tables.append((keys, np.append(starts, len(own)), lang, np.log1p(times / added).astype(np.float32), unseen))
    return langs, tables


def identified(docs: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs, learned from train (default: docs)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs if train is None else train))
    key = uuid.uuid4().hex

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once("language", key, lambda: Model(*shared.value))
        for batch in small(batches, "text", 2 << 20):
            found = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))
    return spread(docs.select("doc_id", held.alias("held_out"), "text")).mapInArrow(
        predicted, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def spoken(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs with a language: neither `und` nor scored below `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    key = uuid.uuid4().hex

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once("language", key, lambda: Model(*shared.value))
        for batch in small(batches, "text", 2 << 20):
            found = model.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return spread(docs).mapInArrow(kept, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_language": op6}
ORACLES: dict = {}
