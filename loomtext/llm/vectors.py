"""Vectors of a table as matrices, batch by batch, for operators that work on whole vectors inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: largest whole number that a floor may give, far inside 64 bits
LIMIT = 1 << 61


def usable(vector: Column) -> Column:
    """Whether a vector is there and every component is a finite number."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def kept_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector takes part, with the components as doubles."""
    return df.withColumn(vector, F.col(vector).cast("array<double>")).where(usable(F.col(vector)))


def one_length(df: DataFrame, vector: str) -> int:
    """The common length of all vectors, 0 for an empty table; vectors of several lengths are an error."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors have from {low} to {high} components")
    return low or 0


def matrix(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    """The vectors of a batch as rows; each has ``dims`` components."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(values.offsets.to_numpy())
    if values.null_count or (lengths != dims).any():
        raise ValueError(f"a vector does not have {dims} components")
    return flat.reshape(-1, dims)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as 64-bit whole numbers; beyond their range is an error."""
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a component times {scale} does not fit 64 bits")
    return out.astype(np.int64)


def lists(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    n, dims = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, max(dims, 1), dtype=np.int32)[: n + 1] if dims else np.zeros(n + 1, np.int32)), pa.array(rows.reshape(-1)))
