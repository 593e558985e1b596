"""Vectors of integers, as rows and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this would let a squared distance leave 64 bits.
LARGEST = 1 << 26


def is_finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def as_integers(vec: Column, scale: float = 256.0) -> Column:
    """Each component as floor(scale * x) in double arithmetic; beyond ``LARGEST`` that is an error."""

    def one(x: Column) -> Column:
        v = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(v) <= LARGEST, v.cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")))

    return F.transform(vec, one)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of integers as a matrix of doubles; shorter ones are filled up with zeros."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(whole, pa.ChunkedArray):  # without any chunk
        whole = pa.concat_arrays(whole.chunks) if whole.num_chunks else pa.array([], pa.list_(pa.int32()))
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(whole) else np.empty(0, np.int64)
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of all rows of two matrices of integers, exactly, as 64-bit integers."""
    if a.shape[1] * largest * largest < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def folder_of(staged: DataFrame) -> str | None:
    """Where a staged table lies."""
    files = staged.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None
