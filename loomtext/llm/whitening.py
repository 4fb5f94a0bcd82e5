"""Embedding whitening by polarisation covariance.

Variances need only squares. Each task adds up the squared centred values of every dimension and of the sum of every pair of
dimensions, in whole numbers; then cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, exact until the one division that makes it
a double. The covariance goes through ``eigh``, whose size depends on the dimensions alone.

Components become whole numbers x = floor(scale * c) + shift. With n vectors and sums S the centred value is n * x - S, kept as
n * u - r with u = x - m, m the whole number next to the mean and r = S - n * m: tasks square the small u, and n and r come in
afterwards, so nothing overflows or cancels however many vectors there are.

Defined results: vectors that are null or hold null or non-finite components take no part and give no row; vectors of different
lengths are an error; equal vectors and equal ids each count as a row; an empty table and vectors without components give no
components; a direction without variance (fewer vectors than dimensions, equal dimensions) has no unit scale and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import place, positional
from .vectors import floors, kept_vectors, lists, matrix, one_length

#: cells of the table of pair sums that a task holds at a time
CELLS = 1 << 18


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: the number of vectors, per dimension the whole mean and the rest of the sum, directions and variances."""

    n: int
    middle: np.ndarray  # m
    rest: list[int]  # S - n * m
    directions: np.ndarray  # a column each
    variances: np.ndarray
    total: float
    scale: int
    shift: int

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total


def whole(batch: pa.RecordBatch, column: str, dims: int, scale: int, shift: int) -> np.ndarray:
    return floors(matrix(batch, column, dims), scale) + shift


def square_sums(u: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[int]:
    """For each pair of positions the sum over the rows of (u[left] + u[right]) ** 2, exact."""
    total = np.zeros(len(left), dtype=object)
    top = 2 * max(int(np.abs(u).max(initial=0)), 1)
    if top * top >= 1 << 62:  # squares beyond 64 bits: Python's whole numbers
        u, fits = u.astype(object), 1
    else:
        fits = (1 << 62) // (top * top)
    step = max(1, min(CELLS // max(len(left), 1), fits))
    for at in range(0, len(u), step):
        part = u[at : at + step]
        pair = part[:, left] + part[:, right]
        total += (pair * pair).sum(axis=0).astype(object)
    return total.tolist()


def _sums(df: DataFrame, make, count: int) -> tuple[int, list[int]]:
    """Rows and ``count`` exact sums over the batches; each task sends one row for each sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * count
        for batch in batches:
            rows += batch.num_rows
            total = [a + b for a, b in zip(total, make(batch))]
        if rows:
            values = pa.array([Decimal(v) for v in [rows, *total]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, count), pa.int32()), values], ["at", "v"])

    parts = df.mapInArrow(run, "at int, v decimal(38,0)").groupBy("at").agg(F.sum("v").alias("v"))
    found = {r.at: int(r.v) for r in parts.collect()}  # one row for each sum
    return found.get(-1, 0), [found.get(i, 0) for i in range(count)]


def fit(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The leading directions of the covariance (divisor n) of all usable vectors; None when there is no component."""
    vectors = kept_vectors(df.select(vector), vector)
    dims = one_length(vectors, vector)
    if not dims:
        return None
    n, sums = _sums(vectors, lambda b: whole(b, vector, dims, scale, shift).sum(axis=0).tolist(), dims)
    middle = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    mid = np.array(middle, dtype=np.int64)
    # a dimension by itself is the pair with a column of zeros behind the last
    left, right = np.triu_indices(dims, 1)
    left, right = np.concatenate([np.arange(dims), left]), np.concatenate([np.full(dims, dims), right])

    def squares(batch):
        u = whole(batch, vector, dims, scale, shift) - mid
        return square_sums(np.hstack([u, np.zeros((len(u), 1), np.int64)]), left, right)

    _, raw = _sums(vectors, squares, len(left))
    # sum of (n * u - r) ** 2, where the u add up to r
    shares = [*rest, 0]
    exact = [n * n * q - n * (shares[a] + shares[b]) ** 2 for q, a, b in zip(raw, left, right)]
    cov = np.zeros((dims, dims))
    for value, a, b in zip(exact, left, right):
        if b == dims:
            cov[a, a] = float(Fraction(value, n**3))
        else:
            cov[a, b] = cov[b, a] = float(Fraction(value - exact[a] - exact[b], 2 * n**3))
    variances, directions = np.linalg.eigh(cov)
    variances, directions = variances[::-1], directions[:, ::-1]
    there = int((variances > variances[0] * dims * 1e-15).sum()) if variances[0] > 0 else 0
    keep = min(components, there)
    if not keep:
        return None
    directions = directions[:, :keep]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(keep)])
    return Whitening(n, mid, rest, directions * signs, variances[:keep], float(np.trace(cov)), scale, shift)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, all their columns, and

    ``deviation`` decimal(38,0): the sum over the dimensions of (n * x - S) ** 2, exact;
    ``whitened`` array<double>: x - S / n on each direction, over the square root of its variance.
    Columns of these names in the table are replaced.
    """
    named = positional(df)
    v = place(df, vector)
    keep = [c for c, name in zip(named.columns, df.columns) if name.lower() not in ("deviation", "whitened")]
    names = [name for name in df.columns if name.lower() not in ("deviation", "whitened")]
    body = named.select(*keep, F.col(v).cast("array<double>").alias("__v"))
    if v not in keep:
        raise ValueError("the vector's column can't have the name of a result")
    dims, n = len(model.middle), model.n
    rest = np.array(model.rest, dtype=np.int64)
    root = np.sqrt(model.variances)
    schema = body.drop("__v").schema.add("deviation", T.DecimalType(38, 0)).add("whitened", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = whole(batch, "__v", dims, model.scale, model.shift) - model.middle
            top = n * (int(np.abs(u).max(initial=0)) + 1)
            if dims * top * top < 1 << 62:
                far = ((n * u - rest) ** 2).sum(axis=1)
                deviation = pa.array(far).cast(pa.decimal128(38, 0))
            else:
                far = ((n * u.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(int(x)) for x in far], pa.decimal128(38, 0))
            white = (u - rest / n) @ model.directions / root
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "__v"]
            yield pa.RecordBatch.from_arrays([*columns, deviation, lists(white)], names=schema.names)

    return body.where(F.col("__v").isNotNull()).transform(lambda d: kept_vectors(d, "__v")).mapInArrow(run, schema).toDF(*names, "deviation", "whitened")


def identity_error(white: DataFrame, components: int, whitened: str = "whitened") -> float:
    """The largest absolute entry of the covariance of the whitened columns minus the identity, over all rows.

    ``covar_pop`` merges running means and products of differences from them, so values are centred before they multiply.
    """
    entry = lambda i: F.col(whitened)[i]
    off = [F.abs(F.covar_pop(entry(i), entry(j)) - (1.0 if i == j else 0.0)) for i in range(components) for j in range(i, components)]
    row = white.agg(F.array_max(F.array(*off)).alias("e")).first()
    return float(row["e"])


def whiten_rows(
    df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000
) -> tuple[DataFrame, Whitening, float] | None:
    """Fit, whiten and measure: (written table of whitened rows without their vectors, model, identity error), or None without a component."""
    model = fit(df, vector, components, scale, shift)
    if model is None:
        return None
    white = cut_lineage(whiten(df, model, vector).drop(vector))
    return white, model, identity_error(white, len(model.variances))
