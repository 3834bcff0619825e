"""Vectors: which take part, and lists of an Arrow column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """True for a vector that is not null, not empty and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)
