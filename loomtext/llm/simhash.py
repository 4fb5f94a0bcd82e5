"""Near-duplicates by SimHash: fingerprints of word shingles, linked at a few differing bits.

Texts become 64-bit fingerprints in one pass. Only distinct fingerprints are compared, so a group of
exact copies costs one row. Candidates come from the pigeonring principle: cut the 64 bits into a
ring of segments; if two fingerprints differ in at most ``t`` bits, then from some segment on every
chain of ``l`` consecutive segments differs in at most ``l*t/m`` bits. The chain of length two is
the join key (first segment equal, second within one bit, by leaving out each bit once); longer
chains prune before the full Hamming check.

One shuffle by key brings the members of a bucket together, sorted, and a task streams through them. Buckets
are bounded: one of more than ``BUCKET`` fingerprints is not compared, its members go on to finer keys, and keys that
a sample shows to be far larger are not even shuffled. The last keys are all values within half the allowed distance;
a bucket of these holds at most 2,081 fingerprints, so nothing is left over. A bucket gives the edges of a
spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import fresh, map_batches, texts_of
from .components import components

BITS = 64
DISTANCE = 4
SEED = 42
#: segments of the ring from the highest bit on
RING = (13, 13, 13, 13, 12)
#: a bucket of the last keys can't hold more: 1 + 64 + 64*63/2 values lie within two bits
BUCKET = 2081
#: fingerprints a task makes keys of; the share that is looked at for hot keys, and how many of these are broadcast
TASK_PRINTS, SAMPLE, MAX_HOT = 20_000, 32, 100_000
#: blocks of the second keys; pairs agree in all blocks but at most four
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = np.arange(8) * 256


def fingerprint(text: bytes, words_per_shingle: int = 4) -> int:
    """Signed 64-bit SimHash of a text; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    if len(words) <= words_per_shingle:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        starts = [0] + [e + 1 for e in ends[:-words_per_shingle]]
        hashed = xxhash.xxh64_digest
        digests = [hashed(joined[a:b], SEED) for a, b in zip(starts, ends[words_per_shingle - 1 :])]
    lanes = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8) + _LANE
    counts = np.einsum("lv,vb->lb", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _BYTE_BITS)
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(digests)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", words_per_shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """The columns of ``docs`` but the text, and the fingerprint as a long. Null texts count as empty."""
    kept = [c for c in docs.columns if c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = pa.array([fingerprint(t, words_per_shingle) for t in texts_of(batch, text)], pa.int64())
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], values], [*kept, out])

    schema = docs.select(*kept).withColumn(out, F.lit(0).cast("bigint")).schema
    return map_batches(docs, run, schema)


def _segments(widths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(shift, width) from the highest bit on."""
    out, left = [], BITS
    for w in widths:
        left -= w
        out.append((left, w))
    return out


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _pack(parts: list[tuple[Column, int]]) -> Column:
    return reduce(lambda a, p: F.shiftleft(a, p[1]).bitwiseOR(p[0]), parts[1:], parts[0][0])


def ring_keys(fp: Column) -> Column:
    """Chains of two segments: the first equal, the second within one bit."""
    segments = _segments(RING)
    keys = []
    for i, (shift, width) in enumerate(segments):
        s2, w2 = segments[(i + 1) % len(segments)]
        for j in range(w2):
            rest = _part(fp, s2, w2).bitwiseAND(F.lit(((1 << w2) - 1) & ~(1 << j)))
            keys.append(_pack([(F.lit(i).cast("bigint"), 3), (F.lit(j).cast("bigint"), 4), (_part(fp, shift, width), 16), (rest, 16)]))
    return F.array(*keys)


def block_keys(fp: Column) -> Column:
    """Each choice of all blocks but four, as the bits of these blocks and the number of the choice."""
    segments = _segments(BLOCKS)
    keys = []
    for n, chosen in enumerate(combinations(segments, len(segments) - DISTANCE)):
        mask = sum(((1 << w) - 1) << s for s, w in chosen)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(_signed(mask)))))
    return F.array(*keys)


def middle_keys(fp: Column) -> Column:
    """All values within half the distance: two fingerprints within it share the values half-way."""
    masks = [0] + [1 << i for i in range(BITS)] + [1 << i | 1 << j for i, j in combinations(range(BITS), 2)]
    return F.transform(F.array(*[F.lit(_signed(m)) for m in masks]), lambda m: m.bitwiseXOR(fp))


def _signed(v: int) -> int:
    return v - (1 << BITS) if v >> (BITS - 1) else v


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """(mask, allowed bits) of the chains of three and four segments from a start."""
    segments, out = _segments(RING), []
    for length in (3, 4):
        mask = sum(((1 << w) - 1) << s for s, w in (segments[(start + k) % len(segments)] for k in range(length)))
        out.append((np.uint64(mask), length * DISTANCE // len(segments)))
    return out


_CHAINS = [_chain_masks(i) for i in range(len(RING))]


def ring_start(key: int) -> int:
    """The start segment that is packed into a ring key."""
    return key >> 36


def _forest(values: np.ndarray, checks: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Edges that connect what pairs within the distance connect, by growing from one value at a time."""
    left, edges = values, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.arange(len(left))
            for mask, most in checks:  # longer chains first prune what the full check would
                near = near[np.bitwise_count((left[near] ^ x) & mask) <= most]
            if len(near):
                near = near[np.bitwise_count(left[near] ^ x) <= DISTANCE]
                edges += [(x, v) for v in left[near]]
                front += list(left[near])
                left = np.delete(left, near)
    return edges


def _compare(keys: np.ndarray, prints: np.ndarray, ring: bool, bucket: int, a: list, b: list, dense: list) -> None:
    """Edges and left-over fingerprints of whole buckets, sorted by key."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(keys)]))
    sizes = stops - starts
    two = starts[sizes == 2]
    near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= DISTANCE]
    a.append(prints[near]), b.append(prints[near + 1])
    for i in np.flatnonzero(sizes > 2):
        values = prints[starts[i] : stops[i]]
        if sizes[i] > bucket:
            dense.append(values)
            continue
        # a pair meets under each start whose chain of two it passes, among them one whose longer chains it passes too
        found = _forest(values, _CHAINS[ring_start(int(keys[starts[i]]))] if ring else [])
        if found:
            pairs = np.array(found, np.uint64)
            a.append(pairs[:, 0]), b.append(pairs[:, 1])


def _stream(ring: bool, bucket: int):
    """Rows (key, fp) sorted by both to edges (a, b) and, with a null b, fingerprints of buckets that are too large."""

    def out(a: list, b: list, dense: list) -> pa.RecordBatch:
        left = np.concatenate([*a, *dense, np.zeros(0, np.uint64)]).view(np.int64)
        right = np.concatenate([*b, np.zeros(0, np.uint64)]).view(np.int64)
        none = pa.nulls(len(left) - len(right), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(left), pa.concat_arrays([pa.array(right), none])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, full = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            a, b, dense = [], [], []
            keys = np.concatenate((keys, np.asarray(batch.column("key"))))
            prints = np.concatenate((prints, np.asarray(batch.column("fp")).view(np.uint64)))
            if full is not None:  # the rest of a bucket that is known to be too large
                n = int(np.searchsorted(keys, full, "right"))
                dense.append(prints[:n])
                keys, prints = keys[n:], prints[n:]
            if len(keys):
                n, full = int(np.searchsorted(keys, keys[-1])), None
                if n:
                    _compare(keys[:n], prints[:n], ring, bucket, a, b, dense)
                keys, prints = keys[n:], prints[n:]
                if len(keys) > bucket:
                    full = keys[0]
                    dense.append(prints)
                    keys, prints = keys[:0], prints[:0]
            yield out(a, b, dense)
        if len(keys):
            a, b, dense = [], [], []
            _compare(keys, prints, ring, bucket, a, b, dense)
            yield out(a, b, dense)

    return run


def _level(prints: DataFrame, keys, ring: bool, bucket: int, last: bool) -> DataFrame:
    """(a, b): edges of all buckets of one kind of key, and with a null b what is left for finer keys."""
    # few bytes but many keys a row: by rows, not by bytes
    spread = prints.repartition(max(1, prints.count() // TASK_PRINTS), "fp")
    rows = spread.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    far = None
    if not last:
        some = rows.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").count()
        hot = cut_lineage(some.where(F.col("count") > max(2 * bucket // SAMPLE, 8)).select("key"))
        if 0 < hot.count() <= MAX_HOT:
            # which keys these are changes no result: their members go on to the finer keys
            far = rows.join(F.broadcast(hot), "key", "left_semi").select("fp").distinct()
            rows = rows.join(F.broadcast(hot), "key", "left_anti")
    sorted_rows = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = sorted_rows.mapInArrow(_stream(ring, bucket), "a bigint, b bigint")
    return cut_lineage(found if far is None else found.unionByName(far.select(F.col("fp").alias("a"), F.lit(None).cast("bigint").alias("b"))))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within
    the distance. ``bucket`` bounds what one task compares at a time; smaller values give the same
    components by finer keys, but only the last keys may hold up to 2,081 values in any case."""
    edges, left = None, prints
    for keys, ring, most, last in ((ring_keys, True, bucket, False), (block_keys, False, bucket, False), (middle_keys, False, BUCKET, True)):
        level = _level(left, keys, ring, most, last)
        found = level.where("b is not null")
        edges = found if edges is None else edges.unionByName(found)
        left = cut_lineage(level.where("b is null").select(F.col("a").alias("fp")).distinct())
        if left.isEmpty():
            break
    return edges


def near_duplicates(prints: DataFrame, fp: str = "fingerprint", bucket: int = BUCKET) -> DataFrame:
    """(fp, component) for each distinct fingerprint of the column; the component is a fingerprint."""
    distinct = cut_lineage(prints.select(F.col(fp).alias("fp")).where("fp is not null").distinct())
    linked = components(links(distinct, bucket))
    return distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame, bucket: int = BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the smallest doc_id that links reach) per row.

    Fixed results: null and word-free texts have fingerprint 0 and link like any other; repeated rows
    stay and share a component; null ids are passed over when the smallest is taken, so a component of
    null ids alone has a null component_id; an empty table gives no rows; other columns are not read.
    """
    prints = cut_lineage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    classes = near_duplicates(prints, bucket=bucket)
    lowest = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")).join(classes, F.col("fingerprint") == F.col("fp"))
    named = lowest.groupBy("component").agg(F.min("low").alias("component_id"))
    # written so that the join below meets two exchanges, of which Spark can split a hot side
    names = cut_lineage(lowest.join(named, "component").select("fp", "component_id"))
    out = prints.join(names, F.col("fingerprint") == F.col("fp"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id, then text hash.

    Ids that are null come last in that order. Rows equal in id and text count as one.
    """
    key = F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(F.col(doc_id), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))
    prints = cut_lineage(fingerprints(docs.select(key.alias("k"), F.col(text).alias("text"))))
    classes = near_duplicates(prints, bucket=bucket)
    lowest = prints.groupBy("fingerprint").agg(F.min("k").alias("k")).join(classes, F.col("fingerprint") == F.col("fp"))
    first = cut_lineage(lowest.groupBy("component").agg(F.min("k").alias("__k")).select("__k"))
    mark = fresh(docs.columns, "keep_key")
    kept = docs.withColumn(mark, key).join(first.withColumnRenamed("__k", mark), mark, "left_semi")
    return kept.dropDuplicates([mark]).drop(mark)
