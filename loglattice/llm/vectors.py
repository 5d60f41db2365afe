"""What the two vector operators share: valid vectors in double precision, and repeatable rotations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector with a finite, non-zero length and only finite components."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(wide, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | list, dims: int) -> np.ndarray:
    """Rows of doubles from a list column whose lists all have `dims` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dims)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


@lru_cache(maxsize=256)
def rotation(dims: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; the same for the same arguments everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims, number]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))
