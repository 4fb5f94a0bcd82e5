"""Approximate nearest neighbours by largest inner product, over shifted space-filling curves.

Vectors are projected to a few random directions, shifted, and put in the order of a Hilbert curve; several such curves
with their own directions and shifts each see different neighbours as close. Spark sorts all curves by range, rows get
their rank, and ranks are cut into blocks. A query meets the block of its rank and the one on each side; the best of
each block are found by exact inner products, and a query's blocks over all curves merge.

For inner products of vectors of different lengths a component is added that gives all candidates the same length; a query
has 0 there. Equal vectors are one class, found once and expanded to its smallest ids, so a vector that a third of all
rows share is one candidate. A window is a fixed share of all ranks, so that the share of the table a query meets does not fall as
the table grows; work grows with rows * queries. A window beyond ``BLOCK`` ranks is cut into blocks for tasks of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_batches

CURVES, WINDOW, DIMENSIONS, GRID_BITS = 32, 512, 8, 6
#: a window is this share of a curve's ranks, and at least WINDOW of them
SHARE = 0.01
#: ranks of a block and queries sent to it by one task at most, scores held at a time, lists that one row merges
BLOCK, QUERIES, SCORES, FAN = 8_192, 32_768, 1 << 21, 96
#: rows that the spread of projections is measured on
FIT_ROWS = 20_000
SALTS = 64
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells (n, d), d * bits <= 63."""
    x = np.ascontiguousarray(cells.T.astype(np.uint32))
    d = len(x)
    for level in range(bits - 1, 0, -1):
        one, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            high = (x[i] & one) > 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] >> np.uint32(level)) & 1 > 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.uint64)
    return key.astype(np.int64)


class Curves:
    """Directions, shifts and spread of each curve."""

    def __init__(self, sample: np.ndarray, curves: int, dimensions: int, bits: int, seed: int = SEED):
        rng, size = np.random.default_rng(seed), sample.shape[1]
        d = min(dimensions, size)
        self.bits = bits
        self.maps, self.shifts, self.scales = [], [], []
        for _ in range(curves):
            directions = np.linalg.qr(rng.normal(size=(size, d)))[0]
            spread = (sample @ directions).std(0)
            self.maps.append(directions)
            self.scales.append(np.where(spread > 0, spread, 1.0))
            self.shifts.append(rng.uniform(-0.5, 0.5, d))

    def keys(self, points: np.ndarray, curve: int) -> np.ndarray:
        """Cells span four spreads to either side of 0; what lies beyond is in the outermost ones."""
        unit = (points @ self.maps[curve] / self.scales[curve] + 4 + self.shifts[curve]) / 8
        cells = np.clip(unit * (1 << self.bits), 0, (1 << self.bits) - 1)
        return hilbert(cells, self.bits)


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v) of vectors with an id, not null or zero, all components finite; v as bytes of doubles."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or not v or None in v:
                continue
            a = np.array(v, np.float64) + 0.0  # no negative zeros
            if np.isfinite(a).all() and a.any():
                ids.append(i), out.append(a.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    return map_batches(vectors.select(F.col("vec_id").cast("bigint"), F.col(column).cast("array<double>")), run, "vec_id bigint, v binary")


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(cid, v, members): a row for each distinct vector, with its ``most`` smallest ids; cid is the smallest."""
    near = Window.partitionBy("v", "salt").orderBy("vec_id")
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    few = salted.withColumn("n", F.row_number().over(near)).where(F.col("n") <= most)
    members = F.slice(F.array_sort(F.collect_list("vec_id")), 1, most)
    return few.groupBy("v").agg(members.alias("members")).select(F.element_at("members", 1).alias("cid"), "v", "members")


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _ranked(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``rank`` from 0 inside each curve: sorted by range, numbered per part, parts offset."""
    split = keyed.repartitionByRange("curve", "key", "cid", "asks").sortWithinPartitions("curve", "key", "cid", "asks")
    placed = cut_lineage(split.withColumn("pos", F.monotonically_increasing_id()))
    part = F.shiftright("pos", 33)
    parts = placed.groupBy("curve", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("curve").alias("c"), F.col("part").alias("p"), (before - F.col("low")).alias("shift"))
    # at most a row for each partition and one more for each curve
    joined = placed.join(F.broadcast(offsets), (F.col("curve") == F.col("c")) & (part == F.col("p")))
    return joined.select("curve", "cid", "asks", (F.col("pos") + F.col("shift")).alias("rank"))


_FOUND = "qid bigint, list bigint, cids array<bigint>, scores array<double>"


def _best(qids, queries: np.ndarray, cids: np.ndarray, points: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for each query, ties to the smaller id."""
    order = np.argsort(cids, kind="stable")
    cids, points = cids[order], points[order]
    step = max(1, SCORES // len(cids))
    ids, values = [], []
    for row in (r for at in range(0, len(queries), step) for r in queries[at : at + step] @ points.T):
        if len(row) > k:
            kth = -np.partition(-row, k - 1)[k - 1]
            at = np.flatnonzero(row >= kth)
        else:
            at = np.arange(len(row))
        at = at[np.argsort(-row[at], kind="stable")][:k]
        ids.append(cids[at].tolist()), values.append(row[at].tolist())
    return pd.DataFrame({"qid": qids, "cids": ids, "scores": values})


def _merge(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    ids, values = [], []
    for lists, scores in zip(batch.column("cids").to_pylist(), batch.column("scores").to_pylist()):
        best: dict[int, float] = {}
        for c, s in zip(lists, scores):
            for i, x in zip(c, s):
                best[i] = max(x, best.get(i, x))
        top = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
        ids.append([i for i, _ in top]), values.append([x for _, x in top])
    made = [pa.array(ids, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("list"), *made], ["qid", "list", "cids", "scores"])


def layout(ranks: int, asked: int, window: int | None = None) -> tuple[int, int, int]:
    """Ranks of a block, blocks a query meets to either side of its own, and parts its queries are cut into.

    All blocks a query meets span at least three windows.
    """
    window = window or max(WINDOW, math.ceil(SHARE * ranks))
    pieces = -(-window // BLOCK)
    block, reach = -(-window // pieces), 3 * pieces // 2
    # queries of a block if they lie four times as dense as on average, but no more than there are
    near = min(asked, (2 * reach + 1) * block * min(1.0, 4 * asked / max(1, ranks)))
    return block, reach, max(1, math.ceil(near / QUERIES))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    column: str = "embedding",
    curves: int = CURVES,
    window: int | None = None,
    dimensions: int = DIMENSIONS,
    bits: int = GRID_BITS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row among all other rows.

    ``is_query`` is a condition on vec_id. Without ``window`` it is ``SHARE`` of the ranks. Fixed results: vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows without an id; a row never finds its own id; equal rows count once; ties go to
    the smaller id; vectors of different lengths are an error; an empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(_usable(vectors, column))
    low, high = rows.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    if low != high:
        raise ValueError(f"vectors have from {low // 8} to {high // 8} components")
    classes = cut_lineage(_classes(rows, k + 1))
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sample = [r[0] for r in classes.select("v").orderBy(F.xxhash64("cid")).limit(FIT_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    asked = cut_lineage(rows.where(is_query).join(classes.select("cid", F.col("v").alias("w")), F.col("v") == F.col("w")).select("vec_id", "cid").distinct())
    norm = F.aggregate(F.col("a"), F.lit(0.0), lambda s, x: s + x * x)
    longest = vectors.select(F.col(column).cast("array<double>").alias("a"), "vec_id").where(
        "vec_id is not null and a is not null and not exists(a, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    most = float(longest.agg(F.max(norm)).first()[0])  # squared length of the longest

    def lifted(points: np.ndarray, asks: bool) -> np.ndarray:
        squares = (points * points).sum(1)
        last = np.zeros(len(points)) if asks else np.sqrt(np.maximum(0.0, most - squares))
        scale = np.sqrt(most / squares) if asks else 1.0  # a query's length changes no order
        return np.column_stack([points * np.reshape(scale, (-1, 1)), np.where(last < 1e-6 * np.sqrt(most), 0.0, last)])

    shared = spark.sparkContext.broadcast(Curves(lifted(_matrix(sample), False), curves, dimensions, bits))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, cids, asks = _matrix(batch.column("v").to_pylist()), np.asarray(batch.column("cid")), np.asarray(batch.column("asks").to_pylist(), bool)
        both = np.where(asks[:, None], lifted(points, True), lifted(points, False))
        made = [shared.value.keys(both, c) for c in range(curves)]
        n = len(cids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(curves, dtype=np.int32), n)), pa.array(np.concatenate(made)), pa.array(np.tile(cids, curves)), pa.array(np.tile(asks, curves))],
            ["curve", "key", "cid", "asks"],
        )

    plain = classes.select("cid", "v", F.lit(False).alias("asks"))
    ask = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v", F.lit(True).alias("asks"))
    n_asked = asked.select("cid").distinct().count()
    size, reach, parts = layout(classes.count() + n_asked, n_asked, window)
    met = 2 * reach + 1
    ranked = _ranked(map_batches(plain.unionByName(ask), keys, "curve int, key bigint, cid bigint, asks boolean"))
    block = F.floor(F.col("rank") / size)
    # candidates go to all parts of their block, queries to one part of it and of those beside it
    to = F.when(F.col("asks"), F.sequence(block - reach, block + reach)).otherwise(F.array(block))
    part = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("cid"), F.lit(parts)))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))
    sent = ranked.select("curve", "cid", "asks", F.explode(to).alias("block"), part.alias("parts"))
    spread = sent.select("curve", "cid", "asks", "block", F.explode("parts").alias("part")).join(classes.select("cid", "v"), "cid")

    def in_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("qid", "list", "cids", "scores")})
        q, c = group[asks], group[~asks]
        best = _best(q["cid"].to_numpy(), _matrix(list(q["v"])), c["cid"].to_numpy(), _matrix(list(c["v"])), k + 1)
        # blocks that a query meets stand in a row, so their numbers differ in the remainder
        best.insert(1, "list", key[0] * met + key[1] % met)
        return best

    best, lists = spread.groupBy("curve", "block", "part").applyInPandas(in_block, _FOUND), curves * met
    while True:
        # few lists in a row, however many blocks a query meets
        some = best.groupBy("qid", F.floor(F.col("list") / FAN).alias("list")).agg(F.collect_list("cids").alias("cids"), F.collect_list("scores").alias("scores"))
        best, lists = map_batches(some, lambda b: _merge(b, k + 1), _FOUND), -(-lists // FAN)
        if lists == 1:
            break
    best = cut_lineage(best)
    hits = best.select("qid", F.explode(F.arrays_zip("cids", "scores")).alias("h")).select("qid", F.col("h.cids").alias("cid"), F.col("h.scores").alias("score"))
    members = hits.join(classes.select("cid", "members"), "cid")
    near = members.groupBy("qid").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("score")).alias("d"), m.alias("i"))))).alias("all"))
    near = cut_lineage(near.select("qid", F.slice(F.array_sort("all"), 1, k + 1).alias("all")))
    out = asked.join(near, F.col("cid") == F.col("qid"))
    others = F.slice(F.filter("all", lambda x: x["i"] != F.col("vec_id")), 1, k)
    out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.d")).alias("score"))
