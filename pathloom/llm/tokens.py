"""Token counts of whole texts, with a shortcut for words that are one token.

The vocabulary is a sentencepiece BPE model with byte fallback: blanks become U+2581, one
is put in front, and neighbouring pieces merge whenever their concatenation is a piece,
best score first, leftmost first within a score.

Two facts are proved from the vocabulary on the driver, once and before any text is read:
 * no piece has U+2581 after another character, so nothing merges across the start of a
   run of blanks, and such runs with what follows are pre-tokens that stand alone;
 * whole: the pieces that, merged from their own characters, end as one token. A pre-token
   in that set counts 1. (A piece may fail: its parts may never meet in the merge order.)
Other pre-tokens are cut where no piece has that pair of neighbouring characters, merged,
and characters that are no piece count their UTF-8 bytes. Their counts are remembered in
a bounded memory.

Defined results: null counts as the empty text, 0 tokens and 0 bytes; strings of control
pieces inside a text are ordinary text; very long texts are counted whole, a slice at a time;
of two equal pairs the left one merges first, so no ties are left; repeated rows are kept; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.memo import Memo, once
from pathloom.llm.rows import small
from pathloom.session import ship, spread

SPACE = "\u2581"
LIMIT = 4096
SLICE = 1 << 16


class Counter:
    """Counts of one model file; pickled without what it remembers of texts, so proofs are made once and sent."""

    def __init__(self, data: bytes, memory: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(model.get_piece_size())
        if model.encode("a  b ", out_type=str)[-1] != SPACE or model.encode("ﬁ", out_type=str)[-1] != "ﬁ":
            raise ValueError("only models that keep texts as they are (identity, all blanks) are supported")
        #: Ordinary pieces with their order: a smaller number merges first.
        self.rank = {
            model.id_to_piece(i): -model.get_score(i)
            for i in ids
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece has a blank inside: pre-tokens would not stand alone")
        self.pairs = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.whole = frozenset(p for p in self.rank if len(self._merged(p)) == 1)
        #: The tokens of a line feed, if it merges with nothing.
        self.newline = 0 if any("\n" in p for p in self.pairs) else 1
        self.memory = memory
        self._remember()

    def _remember(self) -> None:
        self.memo = Memo(self._counted, self.memory)
        self.parts = Memo(self._part, self.memory // 2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "parts")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._remember()

    def _merged(self, text: str) -> list[str]:
        """The pieces of a short text."""
        get, none, parts = self.rank.get, 3e38, list(text)
        known = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while known and (best := min(known)) != none:
            k = known.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del known[k]
            if k < len(known):
                known[k] = get(parts[k] + parts[k + 1], none)
            if k:
                known[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def _merged_long(self, text: str) -> list[str]:
        rank, s, n = self.rank, list(text), len(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, s[k] + s[k + 1]) for k in range(n - 1) if (r := rank.get(s[k] + s[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, joined = heapq.heappop(heap)
            m = right[k]
            if not s[k] or m < 0 or s[k] + s[m] != joined:
                continue
            s[k], s[m], right[k] = joined, "", right[m]
            if right[k] >= 0:
                left[right[k]] = k
            for a in (left[k], k):
                if a >= 0 and right[a] >= 0 and (r := rank.get(s[a] + s[right[a]])) is not None:
                    heapq.heappush(heap, (r, a, s[a] + s[right[a]]))
        return [x for x in s if x]

    def _part(self, part: str) -> int:
        pieces = self._merged(part) if len(part) <= 200 else self._merged_long(part)
        return sum([1 if p in self.rank else len(p.encode("utf-8", "surrogatepass")) for p in pieces])

    def _counted(self, word: str) -> int:
        """The tokens of one pre-token."""
        if word in self.whole:
            return 1
        pairs = self.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs]
        if not cuts:
            return self._part(word)
        return sum([self.parts[word[a:b]] for a, b in zip([0, *cuts], [*cuts, len(word)])])

    def count(self, text: str | None) -> int:
        """The tokens of a whole text, slice by slice (cut before a blank)."""
        if not text:
            return 0
        n, at, size, seen = 0, 0, len(text), self.memo.__getitem__
        while at < size:
            stop = size
            if size - at > SLICE and (cut := _START.search(text, at + SLICE)):
                stop = cut.end() - 1
            lines = [text[at:stop] if at else " " + text[:stop]]
            if self.newline:
                lines = lines[0].split("\n")
                n += self.newline * (len(lines) - 1)
            for line in lines:
                first, *words = line.split(" ")
                if "" in words or SPACE in line:
                    n += sum(map(seen, _PRE.findall(line.replace(" ", SPACE))))
                else:
                    n += (seen(first) if first else 0) + sum(map(seen, [SPACE + w for w in words]))
            at = stop
        return n


#: A blank after something else: a pre-token starts at the blank.
_START = regex.compile(f"[^ {SPACE}] ")
_PRE = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@lru_cache(2)
def _proved(path: str) -> Counter:
    with open(path, "rb") as f:
        return Counter(f.read())


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text).

    path: a model file; the driver reads it, proves which pieces stand alone and broadcasts that, a
    few megabytes.
    """
    ship(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(_proved(path)), uuid.uuid4().hex

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once("tokens", key, lambda: shared.value)
        for batch in small(batches, "text"):
            values = batch.column("text").to_pylist()
            tokens = np.array([counter.count(t) for t in values], np.int64)
            size = np.array([len(t.encode()) if t else 0 for t in values], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_token_counts": op9}
ORACLES: dict = {}
