"""Ordered work that stays spread out when one key holds a large share of the rows.

A plain window sends a whole key to one task. Here the order of a key is cut into buckets by an
expression that rises with the order (for instance ``seq div 65536``): rows are numbered inside a
bucket, and each bucket gets the count of rows before it from a small table of bucket counts.
The result equals the plain window's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

HOT_KEY_ROWS = 1_000_000
_FEW = 10_000


def same(left: DataFrame, right: DataFrame, names: list[str], suffix: str = "") -> Column:
    return reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(right[n + suffix]) for n in names]
    )


def attach(df: DataFrame, side: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """Left join on null-safe keys that keeps the left key columns."""
    renamed = side.select(*[F.col(n).alias(n + "__r") for n in names], *values)
    return df.join(renamed, same(df, renamed, names, "__r"), "left").drop(*[n + "__r" for n in names])


def unless_null(key: Column, other: Column) -> Column:
    """A join key for an outer join that spreads its NULLs: in their place stands a value that can
    match nothing, made from another column. Else all NULL keys go to one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), other.cast("string")))


def row_number_by(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    buckets: list[Column],
    out: str = "rn",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """``row_number`` per key; keys with more than ``hot_rows`` rows are cut into buckets.

    ``buckets`` are ascending expressions that never fall when ``order`` advances. Keys are
    counted first: without hot keys this is the plain window, with one shuffle. Otherwise only
    the hot keys' rows take the bucketed way. Without keys the whole table counts as hot.
    """
    if not keys:
        return _number_in_buckets(df, keys, order, buckets, out)
    plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    hot = df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(F.struct(*keys).alias("__hot"))
    found = hot.limit(_FEW + 1).count()
    if not found:
        return df.withColumn(out, plain)
    few = F.broadcast(hot) if found <= _FEW else hot  # the count bounds what is broadcast
    key = F.struct(*keys)
    cold = df.join(few, key == F.col("__hot"), "left_anti").withColumn(out, plain)
    warm = df.join(few, key == F.col("__hot"), "left_semi")
    return cold.unionByName(_number_in_buckets(warm, keys, order, buckets, out))


def _number_in_buckets(df: DataFrame, keys: list[str], order: list[Column], buckets: list[Column], out: str) -> DataFrame:
    """Rank inside a bucket plus the rows of the buckets before it.

    Key and bucket travel in one struct, whose equality takes NULLs as equal, so the window and
    the join on it share one shuffle. Rows before a bucket are summed level by level: before its
    first part among all, before its second part among those with the same first, and so on. So no
    task sees more than the distinct values of one part.
    """
    names = [f"b{i}" for i in range(len(buckets))]
    cut = df.withColumn("__kb", F.struct(*keys, *[b.alias(n) for n, b in zip(names, buckets)]))
    # the bucket counts are written once: they are small, and each level below reads them again
    counts = cut_lineage(cut.groupBy("__kb").agg(F.count(F.lit(1)).alias("__n")))
    offsets = counts.select("__kb", F.lit(0).cast("bigint").alias("__before"))
    field = lambda n: F.col("__kb")[n]
    for i, name in enumerate(names):
        upper = F.struct(*[field(n).alias(n) for n in keys + names[: i + 1]])
        sums = counts.groupBy(upper.alias("__u")).agg(F.sum("__n").alias("__s"))
        group = [F.col("__u")[n] for n in keys + names[:i]]
        running = Window.partitionBy(*group).orderBy(F.col("__u")[name]).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("__u", F.coalesce(F.sum("__s").over(running), F.lit(0)).alias("__s"))
        offsets = offsets.join(sums, upper == F.col("__u")).select("__kb", (F.col("__before") + F.col("__s")).alias("__before"))
    ranked = cut.withColumn(out, F.row_number().over(Window.partitionBy("__kb").orderBy(*order)).cast("bigint"))
    return ranked.join(offsets, "__kb").withColumn(out, F.col(out) + F.col("__before")).drop("__kb", "__before")


def in_order(df: DataFrame, out: str = "rank") -> DataFrame:
    """A sorted table with the place of each row from 1: places inside a partition, and the rows of those before it.

    The table is written once, so that what is numbered is the order in which it came.
    """
    placed = cut_lineage(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    # a row for each partition
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__p", (before - F.col("__low") + 1).alias("__shift"))
    numbered = placed.join(F.broadcast(shifts), part == F.col("__p"))
    return numbered.withColumn(out, (F.col("__at") + F.col("__shift")).cast("bigint")).drop("__at", "__p", "__shift")


def successor(df: DataFrame, keys: list[str], rank: str, values: dict[str, str]) -> DataFrame:
    """Attach values of the next row of a dense rank by an equi-join on (keys, rank)."""
    nxt = df.select(*keys, (F.col(rank) - 1).alias(rank), *[F.col(v).alias(o) for v, o in values.items()])
    return attach(df, nxt, keys + [rank], list(values.values()))


def next_after(probes: DataFrame, targets: DataFrame, keys: list[str], at: str, tie: str, target: str, parts: int | None = None) -> DataFrame:
    """For each probe the first target of its key that lies after it in (at, tie) order, NULL without one.

    Probes and targets are cut into ranges of (key, at, tie), latest first, so a key with most of the rows is spread over as many
    tasks as it fills; tasks pass over their range once and remember the last target. The first probes of a range may have to look
    over its edge: they take what the range before it ended with, from a table with one row for each range.
    """
    rest = [c for c in probes.columns if c not in [*keys, at, tie]]
    carried = probes.select(F.struct(*rest).alias("p")).schema["p"].dataType
    kind = targets.schema[target].dataType
    t = targets.select(*keys, at, tie, F.lit(1).alias("__k"), target, F.lit(None).cast(carried).alias("__p"))
    p = probes.select(*keys, at, tie, F.lit(0).alias("__k"), F.lit(None).cast(kind).alias(target), F.struct(*rest).alias("__p"))
    order = [*[F.desc(c) for c in [*keys, at, tie]], F.asc("__k")]
    both = t.unionByName(p)
    ranges = both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)
    rows = ranges.sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("__open", T.BooleanType())])
    # written once: which rows lie in which range must not change between the two readings
    passed = cut_lineage(rows.mapInArrow(_last_target(keys, target), schema))
    carries, known = [], None
    for edge in sorted(passed.where("__k = 2").collect(), key=lambda r: r["__part"]):  # a row for each range
        name = tuple(edge[k] for k in keys)
        carries.append((edge["__part"], *(known or (*[None] * len(keys), None))))
        if not (edge["__open"] and known and known[:-1] == name):
            known = (*name, edge[target])
    fields = [T.StructField("__part", T.IntegerType()), *[T.StructField(f"__c{i}", passed.schema[k].dataType) for i, k in enumerate(keys)]]
    table = F.broadcast(probes.sparkSession.createDataFrame(carries, T.StructType([*fields, T.StructField("__carry", kind)])))
    found = passed.where("__k = 0").join(table, "__part", "left")
    mine = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__c{i}")) for i, k in enumerate(keys)], F.col("__open"))
    return found.select(*keys, at, tie, "__p.*", F.when(mine, F.col("__carry")).otherwise(F.col(target)).alias(target))


def _last_target(keys: list[str], target: str):
    """A pass over sorted rows: a probe (0) gets the last target (1) of its key before it. ``__open`` says that none came yet and
    the key is the range's first. After the rows comes an edge (2): the range's last key with its last target."""

    def differs(column: pa.Array, before: pa.Array) -> np.ndarray:
        same = pc.fill_null(pc.equal(column, before), False).to_numpy(zero_copy_only=False)
        return ~(same | (column.is_null().to_numpy(zero_copy_only=False) & before.is_null().to_numpy(zero_copy_only=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_row, held, first_key, seen = None, None, True, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(n)
            new = np.zeros(n, bool)
            for k in keys:
                column = batch.column(k)
                head = column.slice(0, 1) if last_row is None else last_row.column(k)
                new |= differs(column, pa.concat_arrays([head, column.slice(0, n - 1)]))
            kinds = batch.column("__k").to_numpy()
            begins = np.maximum.accumulate(np.where(new, at, -1))
            latest = np.maximum.accumulate(np.where(kinds == 1, at, -1))
            inside = latest >= np.maximum(begins, 0)  # a target of the same key in this batch
            before = (begins < 0) & ~inside  # the key goes on from the batch before
            values = batch.column(target)
            found = values.take(pa.array(latest, mask=~inside))
            if seen and before.any():
                found = pc.if_else(pa.array(before), held, found)
            open_rows = before & first_key & (not seen)
            columns = [found if c == target else batch.column(c) for c in batch.schema.names]
            made = pa.RecordBatch.from_arrays([*columns, pa.array(open_rows)], names=[*batch.schema.names, "__open"])
            yield made.filter(pa.array(kinds == 0))
            last_row = batch.slice(n - 1, 1)
            first_key = first_key and not new.any()
            seen = bool(inside[-1] or (before[-1] and seen))
            held = values[int(latest[-1])] if inside[-1] else (held if seen else None)
        if last_row is not None:
            change = {"__k": pa.array([2], pa.int32()), target: pa.array([held.as_py() if seen else None], last_row.column(target).type)}
            columns = [change.get(c, last_row.column(c)) for c in last_row.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([first_key and not seen])], names=[*last_row.schema.names, "__open"])

    return run


#: pages that end by this row are a bounded top-k; deeper ones number the table in buckets
SHALLOW_ROWS = 10_000


def page(
    df: DataFrame, order: list[Column], buckets: list[Column], index: int, size: int, shallow: int = SHALLOW_ROWS
) -> DataFrame:
    """Page ``index`` (from 0) of ``size`` rows; an index beyond the end gives the last page.

    A shallow page is the tail of the first rows in order, of which each task keeps no more than it needs. For a deep one
    row numbers come from buckets, so it needs no sort of the whole table in one task either.
    """
    total = df.count()
    first = min(index, max(-(-total // size) - 1, 0)) * size
    if first + size <= shallow:
        top = df.orderBy(*order).limit(first + size)
        numbered = top.withColumn("__rn", F.row_number().over(Window.orderBy(*order)))
    else:
        numbered = row_number_by(df, [], order, buckets, "__rn")
    return numbered.where((F.col("__rn") > first) & (F.col("__rn") <= first + size)).orderBy("__rn").drop("__rn")
