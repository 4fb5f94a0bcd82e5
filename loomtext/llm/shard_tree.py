"""Sharding by a weighted hash tree, natively: region, rack, shard.

At each node a document draws one hash for each child, divides its exponential by the child's weight, and goes to the
child with the smallest draw. A draw depends on the document's id and the child alone, so a change of weight moves
documents only into or out of the subtrees whose weights change, and what it moves is their share.

The first ``BASE`` shards fill regions of racks evenly. Each later shard stands in a region and a rack of its
own, so no other weight changes when it is added, and documents move only into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BASE = 16
RACKS, RACK_SHARDS = 2, 4
#: rows of the table of slot offsets, which is broadcast: shards times buckets stay below it
MAX_OFFSETS = 1 << 16


class Tree:
    """Nodes by number: children as (node, weight); leaves as shards. Node 0 is the root."""

    def __init__(self):
        self.children: list[list[tuple[int, float]]] = [[]]
        self.shard: list[int | None] = [None]
        self.key: list[str] = [""]

    def add(self, parent: int, key: str, shard: int | None = None) -> int:
        self.children.append([]), self.shard.append(shard), self.key.append(key)
        self.children[parent].append((len(self.children) - 1, 0.0))
        return len(self.children) - 1

    def weigh(self, weights: dict[int, float], node: int = 0) -> float:
        """Sets each child's weight to the sum of the shards below it."""
        if self.shard[node] is not None:
            return weights.get(self.shard[node], 1.0)
        self.children[node] = [(c, self.weigh(weights, c)) for c, _ in self.children[node]]
        return sum(w for _, w in self.children[node])


def tree(shards: int, base: int = BASE, weights: dict[int, float] | None = None) -> Tree:
    """Regions of racks for the first ``base`` shards, then one region for each further shard."""
    if shards < 1:
        raise ValueError("at least one shard")
    t, per_region = Tree(), RACKS * RACK_SHARDS
    first = min(shards, base)
    for r in range(0, first, per_region):
        region = t.add(0, f"r{r // per_region}")
        for k in range(r, min(r + per_region, first), RACK_SHARDS):
            rack = t.add(region, f"r{r // per_region}/k{k // RACK_SHARDS}")
            for s in range(k, min(k + RACK_SHARDS, first)):
                t.add(rack, f"s{s}", s)
    for s in range(first, shards):
        region = t.add(0, f"own{s}")
        t.add(t.add(region, f"own{s}/k"), f"s{s}", s)
    t.weigh(weights or {})
    return t


def shard_of(key: Column, t: Tree) -> Column:
    """The shard of a key: three descents by weighted draws. Shards of weight 0 get nothing."""
    kind = "array<array<struct<node:int,key:string,weight:double,shard:int>>>"
    rows = F.array(*[
        F.array(*[
            F.struct(F.lit(c).alias("node"), F.lit(t.key[c]).alias("key"), F.lit(float(w)).alias("weight"), F.lit(t.shard[c]).alias("shard"))
            for c, w in children if w > 0
        ])
        for children in t.children
    ]).cast(kind)

    def draw(child: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(child["key"], key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((-F.ln(unit) / child["weight"]).alias("d"), child["node"].alias("node"), child["shard"].alias("shard"))

    at = F.lit(0)
    for _ in range(3):
        best = F.array_min(F.transform(F.element_at(rows, at + 1), draw))
        at = best["node"]
    return best["shard"]


def assign(docs: DataFrame, shards: int = BASE, base: int = BASE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row.

    Fixed results: a null text has size 1 and checksum 0; null ids are one key; repeated ids share a shard and get
    slots of their own; an empty table gives no rows; other columns are not read. Slots count from 0 in each shard without
    gaps, by hash bucket, then id; among rows equal in id, size and checksum their order is any.
    """
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"),
        shard_of(key, tree(shards, base)).alias("shard"),
        shard_of(key, tree(shards + 1, base)).alias("grown_shard"),
        F.spark_partition_id().alias("split"),
    )
    buckets = max(1, MAX_OFFSETS // shards)
    # the split of the scan spreads even an id that makes up a third of all rows; written once, so both uses agree
    place = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "split"), F.lit(buckets)).cast("int")
    cut = cut_lineage(rows.withColumn("bucket", place).drop("split"))
    running = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    # at most MAX_OFFSETS rows
    out = cut.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "bucket"])
    slot = (F.col("before") + F.col("inside") - 1).cast("bigint").alias("slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
