"""Trigrams of texts in Arrow batches: their bits for each row, and for each trigram the blocks of a zone that have it.

A trigram is a number: three code points of 21 bits each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SHIFT, POINT = 21, (1 << 21) - 1
#: Bits that trigrams of code points below 8192 don't have; such trigrams fit into 39 bits.
NARROW, LOW = 13, (1 << 13) - 1
WIDE = sum((POINT ^ LOW) << (SHIFT * k) for k in range(3))
#: Bits of a block's number within a run of rows.
BLOCKS = 24
#: So many (trigram, block) pairs are held before they are given out.
HELD = 4 << 20


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each has; a null is empty, and bytes that are no text are U+FFFD."""
    raw = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not data.size or data.max() < 128:
        return data.astype(np.int64), np.diff(offsets)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets - offsets[0]]
        return points.astype(np.int64), np.diff(upto)
    except UnicodeDecodeError:
        whole = [b.decode(errors="replace") for b in raw.cast(pa.large_binary()).to_pylist()]
        return np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32).astype(np.int64), np.array([len(t) for t in whole])


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams, rows): every trigram of every text, repeats too, with the text's place; in the order of the texts."""
    points, sizes = _points(texts)
    if points.size < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    whole = rows[:-2] == rows[2:]
    return ((points[:-2] << (2 * SHIFT)) | (points[1:-1] << SHIFT) | points[2:])[whole], rows[:-2][whole]


def bits(texts: pa.Array) -> pa.Array:
    """(low, high) for each text: one of 128 bits for each trigram, so what contains the trigrams has their bits."""
    grams, rows = windows(texts)
    out = np.zeros((2, len(texts)), np.uint64)
    if grams.size:
        place = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
        one = np.uint64(1) << (place & np.uint64(63))
        starts = np.append(0, np.flatnonzero(np.diff(rows)) + 1)
        for half, mine in enumerate((place < 64, place >= 64)):
            out[half, rows[starts]] = np.bitwise_or.reduceat(np.where(mine, one, np.uint64(0)), starts)
    return pa.StructArray.from_arrays([pa.array(x.view(np.int64)) for x in out], ["low", "high"])


def bits_of(grams: list[str]) -> tuple[int, int]:
    """The bits of some trigrams, all together."""
    found = bits(pa.array(grams, pa.string())).to_pylist()
    low = high = 0
    for b in found:
        low, high = low | b["low"], high | b["high"]
    return low, high


def _distinct(grams: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (trigram, block) pairs, sorted; blocks are below 2 ** BLOCKS."""
    if np.any(grams & WIDE):
        known, place = np.unique(grams, return_inverse=True)
        both = np.unique((place.astype(np.int64) << BLOCKS) | blocks)
        return known[both >> BLOCKS], both & ((1 << BLOCKS) - 1)
    short = ((grams >> (2 * SHIFT)) << (2 * NARROW)) | (((grams >> SHIFT) & LOW) << NARROW) | (grams & LOW)
    both = np.unique((short << BLOCKS) | blocks)
    short = both >> BLOCKS
    return ((short >> (2 * NARROW)) << (2 * SHIFT)) | (((short >> NARROW) & LOW) << SHIFT) | (short & LOW), both & ((1 << BLOCKS) - 1)


def _listed(zone: int, first: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    grams, blocks = _distinct(np.concatenate([g for g, _ in held]), np.concatenate([b for _, b in held]))
    starts = np.append(0, np.flatnonzero(np.diff(grams)) + 1)
    known = grams[starts]
    text = np.stack([known >> (2 * SHIFT), (known >> SHIFT) & POINT, known & POINT], axis=1).astype(np.uint32).tobytes().decode("utf-32-le")
    names = pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, grams.size), pa.int32()), pa.array(blocks + first, pa.int64()))
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(known), zone, np.int32)), lists], ["gram", "zone", "blocks"])


def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(zone, block, text), where a zone's rows lie together -> (gram, zone, blocks): each trigram of a zone with its blocks.

    A zone in pieces gives a trigram once for each piece, and a block that is cut is in two of them.
    """
    zone, first, held = None, 0, []
    for batch in batches:
        zones = batch.column("zone").to_numpy()
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(zones)) + 1).tolist(), len(zones)] if len(zones) else []
        for start, end in zip(cuts, cuts[1:]):
            some = blocks[start:end]
            if held and (zones[start] != zone or sum(len(g) for g, _ in held) > HELD or some.min() < first or some.max() - first >= 1 << BLOCKS):
                yield _listed(zone, first, held)
                held = []
            grams, rows = windows(batch.column("text").slice(start, end - start))
            if grams.size:
                if not held:
                    zone, first = int(zones[start]), int(some.min())
                held.append(_distinct(grams, some[rows] - first))
    if held:
        yield _listed(zone, first, held)
