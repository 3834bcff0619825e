"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Lookahead. Rules apply in order of rank, leftmost first within a rank. Let reach(t) be
how far beyond its own end the text can change whether a token t stands somewhere. A
rule (a, b) -> m changes three things, and depends only on rules of lower rank:
 * an a may go because a b follows:        reach(a) >= len(b) + reach(b)
 * a b may go because an a precedes:       reach(b) >= reach(a) - len(b)
 * an m appears where both stood:          reach(m) >= max(reach(a) - len(b), reach(b))
One pass over the merge list in its order gives all reaches; the largest is the
sufficient lookahead: a token that ends that many symbols before the end of what has
been read stands in every continuation. No merge crosses a boundary of the final
tokens, so after a stable token the transducer starts afresh. A pre-token of any length
is thus encoded in a window of fixed size: every pre-token goes through the transducer, and
those shorter than a window come out when they end. Words of up to 64 characters are
remembered with the ids that the transducer gave them; the ids of longer ones are passed on in
parts as they become stable. The ids of a text are one stream of such parts: it is hashed and
fed to the decoder part by part, and never held.

Texts are normalised and split as the tokenizer file says (NFC, blanks, lower case by
character; contractions, letters, single digits, other marks), in slices cut at blanks.
Strings of added tokens inside a text become their ids, as in the library.

Decoding maps ids to bytes and feeds these to an incremental UTF-8 state machine that
keeps at most three pending bytes; broken sequences become U+FFFD. With surface=True it
gives what the library gives for a file without a decoder: token strings joined by
blanks. With surface=False it gives the plain text: byte tokens and word ends undone.

Defined results: null counts as the empty text: no tokens, two hashes of the empty string;
very long texts are coded whole, a slice at a time; of two equal pairs the left one merges first,
so no ties are left; repeated rows are kept; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.memo import Memo, once
from pathloom.llm.rows import small
from pathloom.session import ship, spread

#: Fixed value: the White_Space characters of Unicode.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = regex.compile(f"[{BLANKS}]")
_NOT_BLANK = regex.compile(f"[^{BLANKS}]+")
#: Characters that str.split takes for blanks and Unicode does not.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
SLICE = 1 << 16


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself, or the next one free from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def reaches(merges: list[tuple[int, int, int]], length: list[int]) -> list[int]:
    """For each token, how far beyond its end the text can decide whether it stands."""
    reach = [0] * len(length)
    for a, b, m in merges:
        ra, rb = reach[a], reach[b]
        reach[m] = max(reach[m], ra - length[b], rb)
        reach[a] = max(ra, length[b] + rb)
        reach[b] = max(reach[b], ra - length[b])
    return reach


class Transducer:
    """The encoder and decoder of one tokenizer file."""

    def __init__(self, data: bytes, memory: int = 250_000):
        spec = json.loads(data)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.plain = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.end] for b in range(256)]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rules = {(a << 17) | b: (rank << 17) | m for rank, (a, b, m) in reversed(list(enumerate(merges)))}
        self.length = [1] * len(self.names)
        for a, b, m in merges:
            self.length[m] = self.length[a] + self.length[b]
        self.lookahead = max(reaches(merges, self.length), default=0)
        self.window = max(256, 2 * self.lookahead)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + BLANKS + r"\p{L}\p{N}]+")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        back = {s: b for b, s in letters.items()}
        self.surface = [s.encode() for s in self.names]
        self.bytes = [self._undone(s, back) for s in self.names]
        self.decimal = [b"%d" % i for i in range(len(self.names))]
        #: Ids of words and of pre-tokens inside words, as the transducer gave them.
        self.memo = Memo(self._word, memory)
        self.parts = Memo(self.pre_token, memory // 2)

    def _undone(self, name: str, back: dict[str, int]) -> bytes:
        if name in self.added:
            return name.encode()
        ends = bool(self.end) and name.endswith(self.end)
        core = name[: -len(self.end)] if ends else name
        return bytes(back[c] for c in core if c in back) + b" " * ends

    # encoding

    def merged(self, symbols: list[int]) -> list[int]:
        """All rules applied to symbols that fit into the window."""
        if len(symbols) > 200:
            return self._merged_long(symbols)
        get, none = self.rules.get, 1 << 60
        known = [get((a << 17) | b, none) for a, b in zip(symbols, symbols[1:])]
        while known and (best := min(known)) != none:
            k = known.index(best)
            symbols[k : k + 2] = [best & 0x1FFFF]
            del known[k]
            if k < len(known):
                known[k] = get((symbols[k] << 17) | symbols[k + 1], none)
            if k:
                known[k - 1] = get((symbols[k - 1] << 17) | symbols[k], none)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        rules, n, s = self.rules, len(symbols), list(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k) for k in range(n - 1) if (r := rules.get((s[k] << 17) | s[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rule, k = heapq.heappop(heap)
            m = right[k]
            if s[k] < 0 or m < 0 or rules.get((s[k] << 17) | s[m]) != rule:
                continue
            s[k], s[m], right[k] = rule & 0x1FFFF, -1, right[m]
            if right[k] >= 0:
                left[right[k]] = k
                if (r := rules.get((s[k] << 17) | s[right[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if left[k] >= 0 and (r := rules.get((s[left[k]] << 17) | s[k])) is not None:
                heapq.heappush(heap, (r, left[k]))
        return [x for x in s if x >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[list[int]]:
        """The tokens of one pre-token in parts, each as soon as no continuation can change it."""
        symbols = iter(symbols)
        kept = list(islice(symbols, self.window))
        while len(kept) >= self.window:
            at, stable, out = 0, len(kept) - self.lookahead, []
            for token in self.merged(list(kept)):
                if at + self.length[token] > stable:
                    break
                at += self.length[token]
                out.append(token)
            yield out
            kept = kept[at:]
            before = len(kept)
            kept += islice(symbols, max(1, self.window - before))
            if len(kept) == before:
                break
        yield self.merged(kept)

    def symbols(self, word: str) -> Iterator[int]:
        """The symbols of one pre-token: its bytes, the last one with the word's end."""
        data = word.encode()
        return chain(map(self.plain.__getitem__, data[:-1]), (self.last[data[-1]],))

    def pre_token(self, word: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.stream(self.symbols(word))))

    def _word(self, word: str) -> tuple[int, ...]:
        if len(parts := self.split.findall(word)) == 1:
            return self.pre_token(parts[0])
        return tuple(chain.from_iterable(map(self.parts.__getitem__, parts)))

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # by character: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def words(self, text: str) -> Iterator[list[str] | str]:
        """Lists of normalised words between blanks, and the strings of added tokens."""
        for k, part in enumerate(self.special.split(text) if self.special and "<" in text else [text]):
            if k % 2:
                yield part
                continue
            at = 0
            while at < len(part):
                cut = _BLANK.search(part, at + SLICE) if len(part) - at > SLICE else None
                stop = cut.start() if cut else len(part)
                piece = self.normal(part[at:stop])
                yield _NOT_BLANK.findall(piece) if _SEPARATORS.search(piece) else piece.split()
                at = stop

    def coded(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text in parts, none larger than a slice."""
        longest = self.memo.longest
        for part in self.words(text or ""):
            if isinstance(part, str):
                yield [self.added[part]]
            elif max(map(len, part), default=0) <= longest:
                yield list(chain.from_iterable(map(self.memo.__getitem__, part)))
            else:
                for word in part:
                    if len(word) <= longest:
                        yield list(self.memo[word])
                        continue
                    for pre in self.split.finditer(word):
                        yield from self.stream(self.symbols(pre[0]))

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text, one by one."""
        return chain.from_iterable(self.coded(text))

    # decoding

    def decoded(self, parts: Iterable[list[int]], surface: bool = True) -> Iterator[str]:
        """Pieces of the text of ids that come in parts; joined they are the whole."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        known, gap, before = (self.surface, b" ", b"") if surface else (self.bytes, b"", b"")
        for ids in parts:
            if ids:
                yield machine.decode(before + gap.join(map(known.__getitem__, ids)))
                before = gap
        yield machine.decode(b"", True)

    def decode(self, ids: Iterable[int], surface: bool = True) -> Iterator[str]:
        """Pieces of the text of single ids, in order."""
        return filter(None, self.decoded(([i] for i in ids), surface))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, hash of the ids, hash of the text decoded from these ids), part by part."""
        ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

        def told() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.coded(text):
                if ids:
                    ids_hash.update(b" " * (n > 0) + b" ".join(map(self.decimal.__getitem__, ids)))
                    n += len(ids)
                    yield ids

        for piece in self.decoded(told()):
            text_hash.update(piece.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text).

    path: a tokenizer file; the driver reads it and broadcasts it, a few megabytes.
    """
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = once("bpe", path, lambda: Transducer(shared.value))
        for batch in small(batches, "text"):
            found = [coder.digests(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array([x[0] for x in found], np.int64)),
                    pa.array([x[1] for x in found], pa.string()),
                    pa.array([x[2] for x in found], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return spread(docs.select("doc_id", "text")).mapInArrow(
        coded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_bpe": op2}
ORACLES: dict = {}
