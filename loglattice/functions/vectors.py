"""Dense vectors: codec, cosine distance and the offline embedder."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

OFFLINE_DIM = 64
log = logging.getLogger(__name__)


def to_text(vector: Column) -> Column:
    return F.to_json(vector)


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def literal(vector: Sequence[float]) -> Column:
    """A constant vector as one literal, folded once by the optimizer whatever its length."""
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in vector) + "]"), "array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """L2-normalised in double; a zero vector becomes nulls and so never has a distance."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))
    return F.get(scaled, F.lit(0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b), in [0, 2]; null for a null, zero or differently sized vector."""
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b)))


def distance_to_unit(a: Column, unit_query: Column) -> Column:
    """Cosine distance to an already normalised query: two passes over `a`, none over the query's norm."""
    return F.when(F.size(a) == F.size(unit_query), F.lit(1.0) - F.try_divide(dot(a, unit_query), norm(a)))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


# ---- hash buckets ---------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def projections(tables: int, bits: int, dims: int) -> np.ndarray:
    """(tables, bits, dims) of +1 and -1, each from the first digit of a digest of its place: the same everywhere."""
    sign = lambda *at: 1.0 - 2.0 * (ord(hashlib.sha256(":".join(map(str, at)).encode()).hexdigest()[0]) % 2)
    return np.array([[[sign(t, b, d) for d in range(dims)] for b in range(bits)] for t in range(tables)])


def bucket_numbers(tables: int, bits: int, dims: int) -> Callable[[Column], Column]:
    """Bucket of a vector in each table: bit b is set on the positive side of projection b. Null for other sizes."""

    @F.arrow_udf("array<int>")
    def numbers(vectors: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
        rows = pc.filter(vectors, fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        # row by row, so that a vector's bucket does not depend on its neighbours in a batch
        side = np.einsum("nd,tbd->ntb", rows, projections(tables, bits, dims)) > 0
        packed = (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
        inside = fits.to_numpy(zero_copy_only=False)
        out = np.zeros((len(vectors), tables), dtype=np.int32)
        out[inside] = packed
        ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=pa.array(~inside))

    return lambda vector: numbers(vector)


# ---- embedders ---------------------------------------------------------------------------------


def token_buckets(text: Column, dims: int) -> Column:
    """ASCII words hashed to bucket numbers, computed in the JVM."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("bigint") % dims).cast("int"),
    )


def _bucket_counter(dims: int, cells: int = 1 << 20):
    rows_per_block = max(1, cells // dims)

    @F.arrow_udf("array<float>")
    def count_buckets(buckets: pa.Array) -> pa.Array:
        out = np.zeros((len(buckets), dims), dtype=np.float32)
        for start in range(0, len(buckets), rows_per_block):
            block = buckets.slice(start, rows_per_block)
            lengths = pc.list_value_length(block).fill_null(0).to_numpy(zero_copy_only=False)
            flat = block.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(len(block), dtype=np.int64), lengths)
            counts = np.bincount(rows * dims + flat, minlength=len(block) * dims).reshape(len(block), dims)
            norms = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
            out[start : start + len(block)] = counts / np.where(norms == 0, 1.0, norms)
        # a fixed-size list reads as one block of values: no per-row objects on the way back
        nulls = buckets.is_null().to_numpy(zero_copy_only=False)
        offsets = np.arange(0, (len(buckets) + 1) * dims, dims, dtype=np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(out.reshape(-1)), mask=pa.array(nulls) if nulls.any() else None
        )

    return count_buckets


def hashed_bag_of_words(dims: int = OFFLINE_DIM) -> Callable[[Column], Column]:
    """Offline default embedder: unit-length word counts over hashed buckets; null text gives null."""
    if dims < 1:
        raise ValueError("dims must be positive")
    counter = _bucket_counter(dims)
    return lambda text: counter(token_buckets(text, dims))


def model_embedder(
    embed_texts: Callable[[list[str]], list[Sequence[float] | None]], batch_size: int = 50
) -> Callable[[Column], Column]:
    """Wrap a batch embedding function: order kept, a failed batch retried text by text, failures null."""

    def one_batch(texts: list[str]) -> list[Sequence[float] | None]:
        if not texts:
            return []
        try:
            vectors = embed_texts(texts)
            if len(vectors) == len(texts):
                return list(vectors)
        except Exception:
            log.warning("a batch of %d texts was not embedded", len(texts), exc_info=True)
        if len(texts) == 1:
            return [None]
        return [v for t in texts for v in one_batch([t])]

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts), dtype=object)
        present = np.flatnonzero(texts.notna().to_numpy())
        for start in range(0, len(present), batch_size):
            rows = present[start : start + batch_size]
            for row, vector in zip(rows, one_batch(texts.iloc[rows].tolist()), strict=True):
                out[row] = None if vector is None else np.asarray(vector, dtype=np.float32)
        return pd.Series(out)

    return lambda text: embed(text)


EMBEDDERS: dict[str, Callable[[], Callable[[Column], Column]]] = {"hashed-bow-64": hashed_bag_of_words}


def embedder(name: str) -> Callable[[Column], Column]:
    try:
        return EMBEDDERS[name]()
    except KeyError:
        raise ValueError(f"unknown embedding model {name!r}; known: {sorted(EMBEDDERS)}") from None
