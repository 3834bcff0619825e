"""Helpers for Arrow batches: columns in, columns out, runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    wide = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(wide).to_pylist()


def small(batches: Iterable[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about `most` bytes (or one row) each."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes) if batch.num_rows else 1
        step = max(1, int(batch.num_rows * most / size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): whole runs of rows with equal keys, in sorted input.

    starts has the first row of each run and, last, the number of rows. A run that
    goes on in the next batch is kept back until it is whole.
    """
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
        starts = _starts(table, keys)
        if starts[-2] > 0:
            yield table.slice(0, starts[-2]), starts[:-1]
        kept = table.slice(starts[-2])
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks(), np.array([0, kept.num_rows])


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        x = table.column(key).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
