"""What the vector operators share: which vectors count, and their numbers in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """A vector of one component at least, none null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column without nulls, each list of dim numbers, as (rows, dim) doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def whole_numbers(x: np.ndarray, scale: float, terms: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers. Beyond +-2^29 / sqrt(terms) they stay at that bound, so that a sum
    of so many squared differences or products fits."""
    most = float(int(2**29 / np.sqrt(max(1, terms))))
    return np.clip(np.floor(scale * x), -most, most).astype(np.int64)


def exact(*parts: np.ndarray) -> type:
    """The kind in which sums of products over a row are exact: doubles, if these integers are small enough."""
    most = max((int(np.abs(p).max()) for p in parts if p.size), default=0)
    return np.float64 if 4 * most * most * max(1, parts[0].shape[-1]) < 2**53 else np.int64
