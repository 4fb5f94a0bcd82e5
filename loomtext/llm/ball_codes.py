"""Vector code compression with ball k-means.

Vectors become whole numbers floor(scale * c) and are cut into equal parts; each position has a codebook. The parts that an entry
has form its ball: the entry in the middle, its farthest part as radius. Another entry can be nearer to some part of the ball only
if half the distance between the two entries is below the radius; these are the neighbours. A part nearer to its entry than half
the way to the nearest neighbour lies in the stable core and is not compared with anything. Beyond, the neighbours sorted by
distance cut the ball into rings: a part between half the way to the k-th and to the next neighbour is compared with the first k
alone, by exact distances in whole numbers. Rings are cut a little generously, so that rounding of roots can't lose a candidate.

A round is one pass that assigns and writes the codes with the parts, and one that adds up each entry's parts in the tasks. The
driver sees the codebooks, 4 x 256 entries, at any size of the table.

Defined results: vectors that are null or hold null or non-finite components take no part and give no row; vectors of different
lengths, or of a length that the parts do not divide, are an error; with fewer rows than entries the codebook is as long as there
are rows; equal rows each count, also among the first entries, where ties of the order go by the vector and null orders come last;
an empty table gives no rows and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, cut_lineage
from .common import fresh, place, positional
from .vectors import floors, kept_vectors, lists, matrix, one_length

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: components below this give distances that doubles hold exactly
EXACT = 1 << 22


@dataclass(frozen=True)
class Balls:
    """The entries of one part position with their neighbours: for each entry the others by distance, as far as its radius asks."""

    entries: np.ndarray
    neighbours: list[np.ndarray]
    halves: list[np.ndarray]  # half the distance to each neighbour, rising


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    top = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if top < EXACT and points.shape[1] * 4 * top * top < 1 << 52:  # every sum below is a whole number that doubles hold
        p, e = points.astype(np.float64), entries.astype(np.float64)
        out = (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)
        return out.astype(np.int64)
    return _wide(points[:, None, :].astype(object) - entries[None, :, :].astype(object))


def own_squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each point to the entry in the same row."""
    diff = points - entries
    if points.size and points.shape[1] * float(np.abs(diff).max()) ** 2 >= 1 << 62:
        return _wide(points.astype(object) - entries.astype(object))
    return (diff * diff).sum(axis=1)


def _wide(diff: np.ndarray) -> np.ndarray:
    """Sums of squares by Python's whole numbers; one that 64 bits can't hold is an error."""
    out = (diff * diff).sum(axis=-1)
    if out.size and out.max() >= 1 << 63:
        raise ValueError("a squared distance does not fit 64 bits")
    return out.astype(np.int64)


def make_balls(entries: np.ndarray, radii: np.ndarray) -> Balls:
    """Neighbours of each entry: half the way to them is within its radius (an upper bound of its parts' distances)."""
    between = np.sqrt(squares(entries, entries).astype(np.float64)) / 2
    neighbours, halves = [], []
    for i, row in enumerate(between):
        order = np.argsort(row, kind="stable")
        order = order[(order != i) & (row[order] <= radii[i] * (1 + 1e-9) + 1e-6)]
        neighbours.append(order)
        halves.append(row[order])
    return Balls(entries, neighbours, halves)


def reassign(points: np.ndarray, codes: np.ndarray, balls: Balls) -> np.ndarray:
    """The nearest entry of each point (ties to the lower index), from the entry it had."""
    out = codes.astype(np.int64)
    far = np.sqrt(own_squares(points, balls.entries[out]).astype(np.float64)) * (1 + 1e-9) + 1e-6
    by_entry = np.argsort(out, kind="stable")
    edges = np.searchsorted(out[by_entry], np.arange(len(balls.entries) + 1))
    for i in range(len(balls.entries)):
        mine = by_entry[edges[i] : edges[i + 1]]
        if not len(mine) or not len(balls.neighbours[i]):
            continue
        # neighbours whose half way the point reaches: none in the stable core
        ring = np.searchsorted(balls.halves[i], far[mine], side="right")
        moved = mine[ring > 0]
        if not len(moved):
            continue
        ring = ring[ring > 0]
        rising = np.argsort(ring, kind="stable")
        # rings of like size go together, so that few distances outside a ring are made
        for group in np.array_split(rising, min(len(rising), 4)):
            near = np.concatenate([[i], balls.neighbours[i][: ring[group].max()]])
            lower = np.sort(near)
            out[moved[group]] = lower[squares(points[moved[group]], balls.entries[lower]).argmin(axis=1)]
    return out


def cut(values: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(values, parts, axis=1)


def starts(rows: DataFrame, order: str, vector: str, entries: int, parts: int, scale: int) -> list[np.ndarray]:
    """The parts of the first rows in order: a bounded top-k."""
    first = rows.orderBy(F.col(order).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    values = floors(np.array([r[0] for r in first], dtype=np.float64), scale)
    return cut(values, parts)


def _assign(rows: DataFrame, vector: str, code: str, balls: list[Balls], scale: int | None) -> DataFrame:
    """The table with new codes. With ``scale`` the vectors are still doubles and have no codes yet."""
    dims = sum(b.entries.shape[1] for b in balls)
    keep = [f for f in rows.schema.fields if f.name not in (vector, code)]
    schema = T.StructType([*keep, T.StructField(vector, T.ArrayType(T.LongType())), T.StructField(code, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = matrix(batch, vector, dims)
            values = floors(values, scale) if scale else values
            old = np.zeros((n, len(balls)), np.uint8) if scale else np.frombuffer(b"".join(batch.column(code).to_pylist()), np.uint8).reshape(n, -1)
            new = np.stack([reassign(p, old[:, k], balls[k]) for k, p in enumerate(cut(values, len(balls)))], axis=1).astype(np.uint8)
            columns = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, lists(values), packed(new)], names=schema.names)

    return rows.mapInArrow(run, schema)


def packed(codes: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = codes.shape
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(codes).tobytes())])


def _codes(batch: pa.RecordBatch, code: str, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(code).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def _gather(rows: DataFrame, vector: str, code: str, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int], int]]:
    """(part, entry) -> (parts, their sums, greatest squared distance), added up in the tasks first."""
    dims, width = sum(b.shape[1] for b in books), books[0].shape[1]
    schema = "part int, entry int, n bigint, sums array<bigint>, far bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        far = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch, code, len(books))
            for k, points in enumerate(cut(matrix(batch, vector, dims), len(books))):
                at = codes[:, k]
                n[k] += np.bincount(at, minlength=len(books[k]))
                np.add.at(sums[k], at, points)
                np.maximum.at(far[k], at, own_squares(points, books[k][at]))
        for k in range(len(books)):
            there = np.flatnonzero(n[k])
            if len(there):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(there), k, np.int32)), pa.array(there.astype(np.int32)), pa.array(n[k][there]), lists(sums[k][there]), pa.array(far[k][there])],
                    names=["part", "entry", "n", "sums", "far"],
                )

    added = F.array(*[F.sum(F.col("sums")[j]) for j in range(width)])
    found = rows.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums"), F.max("far").alias("far"))
    return {(r.part, r.entry): (r.n, r.sums, r.far) for r in found.collect()}  # one row for each entry


def compress(
    df: DataFrame,
    order: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows with a usable vector, without the vector, with ``code`` (binary, a byte for each part) and ``error`` (long, the squared
    distances to the final entries, summed over the parts); and the final codebooks. Columns of these names are replaced."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte, so a codebook has 1 to 256 entries")
    names = [c for c in df.columns if c.lower() not in ("code", "error", vector.lower())]
    named = positional(df)
    body = named.select(*[place(df, c) for c in names], F.col(place(df, vector)).alias("__v"), F.col(place(df, order)).alias("__o"))
    rows = kept_vectors(body, "__v")
    dims = one_length(rows, "__v")
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    if not dims:
        empty = rows.limit(0).drop("__v", "__o").withColumn("code", F.lit(b"")).withColumn("error", F.lit(0).cast("bigint"))
        return empty.toDF(*names, "code", "error"), [np.zeros((0, 0), np.int64)] * parts
    books = starts(rows, "__o", "__v", entries, parts, scale)
    # at first every part counts to entry 0, whose ball has no bound
    balls = [make_balls(b, np.full(len(b), np.inf)) for b in books]
    rows = cut_lineage(_assign(rows.drop("__o"), "__v", "__c", balls, scale))
    for done in range(rounds):
        found = _gather(rows, "__v", "__c", books)
        moved, balls = [], []
        for k, book in enumerate(books):
            new, radii = book.copy(), np.zeros(len(book))
            for i in range(len(book)):
                n, sums, far = found.get((k, i), (0, None, 0))
                if n:
                    new[i] = [s // n for s in sums]
                # the parts are as far from the new entry as from the old one, plus the way between the two
                radii[i] = np.sqrt(float(far)) + np.sqrt(float(own_squares(new[i : i + 1], book[i : i + 1])[0]))
            moved.append(new)
            balls.append(make_balls(new, radii))
        books = moved
        rows = _assign(rows, "__v", "__c", balls, None)
        if done < rounds - 1:
            rows = cut_lineage(rows)
    return _errors(rows, "__v", "__c", books).toDF(*names, "code", "error"), books


def _errors(rows: DataFrame, vector: str, code: str, books: list[np.ndarray]) -> DataFrame:
    dims = sum(b.shape[1] for b in books)
    keep = [f for f in rows.schema.fields if f.name not in (vector, code)]
    schema = T.StructType([*keep, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch, code, len(books))
            values = cut(matrix(batch, vector, dims), len(books))
            error = sum(own_squares(p, books[k][codes[:, k]]) for k, p in enumerate(values))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], batch.column(code), pa.array(error)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, group: str, out: str, error: str = "error") -> DataFrame:
    """Adds the error summed over the rows of equal ``group``, nulls together. Sums meet by a join, which a group of any size passes."""
    coded = cut_lineage(coded)
    key = fresh(coded.columns, "__group")
    sums = coded.groupBy(F.col(group).alias(key)).agg(F.sum(error).alias(out))
    return coded.join(broadcast_if_small(sums), F.col(group).eqNullSafe(F.col(key)), "left").drop(key)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()
