"""Near copies at a Jaccard similarity of word shingles: SimHashes propose first, a complete join of the sets finds the rest, whole sets decide.

The first proposals are those of the pigeonring (``simhash.py``): all texts whose 64-bit fingerprints differ in at most its
distance. It misses none of these, but at a similarity of 0.8 a SimHash differs in 15 % of its bits, and a ring with so wide a
budget has no join key that both finds all pairs and leaves most others out. So the search goes on with wider prints. Their keys are
samples of the bits, long enough for the number of texts and as many as the similarity needs; both follow from the counted rows.
Candidates of these keys pass the two halves of a 128-bit code (one of them keeps half of the budget), the full distance.

Texts with the same words are one row from the start. A text within a few bits of an earlier one of its bucket
stands behind that one. This happens in each task before the shuffle, so a group of any size sends a
few rows a task and key, and a bucket gives edges in proportion to its rows.

What these two miss by chance or by their bounds, the last step finds (``remaining``). All shingles have one order, the common ones last. Of two
sets at the similarity, the first shingles of one, as many as may be missing from the other and one more, hold one of the other's first ones. So texts
meet at each of their first shingles, and all pairs that their lengths and places there allow go on, but those that the proposals have
already brought into one group: a large group of near copies adds no pairs of its own. Bounds on the proposals thus cost or save time but no link.

Candidates of all three pass a bound on the difference of their sets, read from the parities of shingles in hashed places, and last the similarity
of the whole shingle sets, so no pair below it is linked and none that reaches it is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from . import simhash
from .common import fresh, map_batches, texts_of
from .components import components

SEED = 42
#: bits of the print that keys are sampled from, and 64-bit lanes of it that travel with a key
BITS, CODE_LANES = 256, 2
#: expected number of keys that a pair at exactly the similarity shares
SHARED_KEYS = 4.0
#: a text this close to an earlier one (of 128 bits, some 0.94 of the shingles) stands behind it in a bucket
CLOSE = 10
#: standard deviations above the distance expected at the similarity that a candidate may have
MARGIN = 2.2
#: others of its bucket that a text which stands for itself is checked with, nearest first
NEAREST = 3
#: prints whose keys a task makes
TASK_PRINTS = 20_000
#: shingles that are turned into bits at a time
CHUNK = 1 << 16
#: share of the texts that is looked at for common shingles, and how many of these have a rank; neither changes a result
SAMPLE, MAX_RANKED = 32, 100_000
#: rows of a bucket of first shingles up to which all buckets are compared at once; pairs that are held before they are given out
AT_ONCE, HELD_PAIRS = 32, 1 << 17
#: what rounding may take from a bound
SLACK = 1e-6

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = np.arange(BITS // 8) * 256
_EDGE = "key bigint, node bigint, c0 bigint, c1 bigint, other bigint"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, none gives none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    runs = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter((hashed(r, SEED) for r in runs), np.uint64))


def wide_print(shingles: np.ndarray) -> bytes:
    """SimHash of ``BITS`` bits; each 64-bit lane mixes the shingle's hash with the lane's number."""
    counts = np.zeros((BITS // 8, 256), np.int64)
    for at in range(0, len(shingles), CHUNK):
        some = shingles[at : at + CHUNK]
        z = some[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        lanes = (z ^ (z >> np.uint64(31))).view(np.uint8).reshape(len(some), -1) + _LANE
        counts += np.bincount(lanes.ravel(), minlength=BITS * 32).reshape(-1, 256)
    return np.packbits(2 * (counts @ _BYTE_BITS).ravel() > len(shingles)).tobytes()


def parity(shingles: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls in each hashed place, at least two places a shingle and a power of two."""
    places = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def least_difference(p: bytes, q: bytes) -> int:
    """Shingles that are in one set only, at least, from the parities of both; the longer is folded to the shorter."""
    x, y = sorted((np.frombuffer(v, np.uint64) for v in (p, q)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def bit_share(similarity: float) -> float:
    """Expected share of differing bits between equally large sets of that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_plan(texts: int, similarity: float) -> tuple[int, int]:
    """(bits of a key, number of keys): unlike texts rarely share a key, pairs at the similarity share some."""
    width = max(12, math.ceil(math.log2(texts + 1)) + 1)
    return width, math.ceil(SHARED_KEYS / (1 - bit_share(similarity)) ** width)


def budget(similarity: float) -> int:
    """Differing bits of the code that a candidate may have."""
    n, p = 64 * CODE_LANES, bit_share(similarity)
    return int(n * p + MARGIN * math.sqrt(n * p * (1 - p)))


def _weights(width: int, keys: int) -> np.ndarray:
    """(bits, keys): powers of two at the bits of each key; keys of one shuffle of the bits share none."""
    rng, out = np.random.default_rng(SEED), np.zeros((BITS, keys))
    order = np.zeros(0, int)
    for k in range(keys):
        if len(order) < width:
            order = rng.permutation(BITS)
        out[order[:width], k] = 2.0 ** np.arange(width)
        order = order[width:]
    return out


def _distances(codes: np.ndarray, code: np.ndarray, most: int) -> np.ndarray:
    """Differing bits; codes of which no half keeps half of the budget are far without a sum."""
    halves = np.bitwise_count(codes ^ code).astype(np.int16)
    return np.where(halves.min(axis=1) <= most // 2, halves.sum(axis=1), 1000)


def _bucket(codes: np.ndarray, most: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Candidate edges in a bucket, as places, and the places that stand for themselves, in order."""
    edges, own = [], [0]
    held = np.empty_like(codes)
    held[0] = codes[0]
    for i in range(1, len(codes)):
        d = _distances(held[: len(own)], codes[i], most)
        j = int(d.argmin())
        if d[j] <= CLOSE:
            edges.append((own[j], i))
            continue
        near = np.flatnonzero(d <= most)
        if len(near) > NEAREST:
            near = near[np.argsort(d[near], kind="stable")[:NEAREST]]
        edges += [(own[k], i) for k in near]
        held[len(own)] = codes[i]
        own.append(i)
    return edges, own


def _buckets(keys: np.ndarray, nodes: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key to candidate edges (rows of two nodes) and the places that stand for themselves."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    sizes = stops - starts
    stay, edges = np.ones(len(keys), bool), []
    two = starts[sizes == 2]
    halves = np.bitwise_count(codes[two] ^ codes[two + 1]).astype(np.int16)
    d = np.where(halves.min(axis=1) <= most // 2, halves.sum(axis=1), 1000)
    near = two[d <= most]
    edges.append(np.stack((nodes[near], nodes[near + 1]), axis=1))
    stay[two[d <= CLOSE] + 1] = False
    for g in np.flatnonzero(sizes > 2):
        a, b = starts[g], stops[g]
        found, own = _bucket(codes[a:b], most)
        if found:
            edges.append(nodes[np.array(found) + a])
        stay[a:b] = False
        stay[np.array(own) + a] = True
    return np.concatenate(edges), np.flatnonzero(stay)


def _keyed(width: int, count: int, most: int):
    """Prints of a task to rows (key, node, code), one of each close group a key, and rows of edges (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints = [np.zeros(0, np.int64)], []
        for batch in batches:
            nodes.append(np.asarray(batch.column("node")))
            prints += batch.column("print").to_pylist()
        node = np.concatenate(nodes)
        if not len(node):
            return
        raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(node), -1)
        code = np.ascontiguousarray(raw[:, : 8 * CODE_LANES]).view(np.uint64)
        values = np.unpackbits(raw, axis=1).astype(np.float64) @ _weights(width, count)
        for k in range(count):
            key = values[:, k].astype(np.int64) | k << 48
            order = np.lexsort((node, key))
            key, mine, codes = key[order], node[order], code[order]
            edges, own = _buckets(key, mine, codes, most)
            none = pa.nulls(len(edges), pa.int64())
            signed = codes[own].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    # an edge goes to any task, it is not looked at again
                    pa.array(np.concatenate((key[own], edges[:, 0]))),
                    pa.array(np.concatenate((mine[own], edges[:, 0]))),
                    pa.concat_arrays([pa.array(np.ascontiguousarray(signed[:, 0])), none]),
                    pa.concat_arrays([pa.array(np.ascontiguousarray(signed[:, 1])), none]),
                    pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(np.ascontiguousarray(edges[:, 1]))]),
                ],
                ["key", "node", "c0", "c1", "other"],
            )

    return run


def _met(most: int):
    """Rows sorted by key to edges (a, b). Of a bucket that goes on, only the rows that stand for themselves are held."""

    def out(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, CODE_LANES), np.uint64)
        for batch in batches:
            done = np.asarray(batch.column("other").is_valid())
            if done.any():
                some = batch.filter(pa.array(done))
                yield out(np.stack((np.asarray(some.column("node")), np.asarray(some.column("other"))), axis=1))
                batch = batch.filter(pa.array(~done))
            if not batch.num_rows:
                continue
            more = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in ("c0", "c1")], axis=1)
            keys = np.concatenate((keys, np.asarray(batch.column("key"))))
            nodes = np.concatenate((nodes, np.asarray(batch.column("node"))))
            codes = np.concatenate((codes, more))
            edges, own = _buckets(keys, nodes, codes, most)
            yield out(edges)
            last = own[keys[own] == keys[-1]]
            keys, nodes, codes = keys[last], nodes[last], codes[last]

    return run


def candidates(prints: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes that may be as similar; ``prints`` has node and print.

    These are proposals that bring most groups together; the pairs they miss come from ``remaining``."""
    total = prints.count()
    width, count = key_plan(total, similarity)
    most = budget(similarity)
    dealt = prints.select("node", "print").repartition(max(1, total // TASK_PRINTS), "node")
    rows = dealt.mapInArrow(_keyed(width, count, most), _EDGE)
    met = rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met(most), "a bigint, b bigint")
    return cut_lineage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def ring_pairs(prints: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes that the pigeonring links: the first 64 bits of their prints differ in at most its distance.

    They connect what all pairs within the distance connect. Nodes of one fingerprint are linked to the smallest of them."""
    marked = cut_lineage(prints.select("node", F.conv(F.hex(F.substring("print", 1, 8)), 16, -10).cast("bigint").alias("fp")))
    lowest = cut_lineage(marked.groupBy("fp").agg(F.min("node").alias("low")))
    equal = marked.join(lowest, "fp").where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    left, right = (lowest.select(F.col("fp").alias(x), F.col("low").alias(f"low_{x}")) for x in ("a", "b"))
    linked = simhash.links(lowest.select("fp")).join(left, "a").join(right, "b")
    ordered = linked.select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    return cut_lineage(equal.unionByName(ordered).distinct())


def _described(docs: DataFrame, size: int) -> DataFrame:
    """k, two hashes of the words, the number of shingles, and print and parities, which are null where only equal words can be similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        first, second, sizes, prints, parities = [], [], [], [], []
        for text in texts_of(batch, "text"):
            words = words_of(text)
            joined = b" ".join(words)
            digest = xxhash.xxh3_128_digest(joined, SEED)
            first.append(int.from_bytes(digest[:8], "big", signed=True))
            second.append(int.from_bytes(digest[8:], "big", signed=True))
            shingles = shingle_set(words, size)
            sizes.append(len(shingles))
            prints.append(wide_print(shingles) if len(shingles) > 1 else None)
            parities.append(parity(shingles) if len(shingles) > 1 else None)
        hashes = [pa.array(h, pa.int64()) for h in (first, second, sizes)]
        columns = [batch.column("k"), *hashes, *[pa.array(p, pa.binary()) for p in (prints, parities)]]
        return pa.RecordBatch.from_arrays(columns, ["k", "h1", "h2", "size", "print", "parity"])

    numbers = {c: F.lit(0).cast("bigint") for c in ("h1", "h2", "size")}
    schema = docs.select("k").withColumns({**numbers, **{c: F.lit(None).cast("binary") for c in ("print", "parity")}}).schema
    return map_batches(docs, run, schema)


def common_shingles(texts: DataFrame, size: int) -> np.ndarray:
    """Shingles that several of the texts (``text``) have, at most ``MAX_RANKED`` of the commonest, the commonest last."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words_of(t), size) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    counts = map_batches(texts, run, "shingle bigint").groupBy("shingle").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "shingle").limit(MAX_RANKED).select("shingle").collect()
    return np.array([r[0] for r in reversed(rows)], np.int64).view(np.uint64)


def first_shingles(shingles: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all: two sets at the similarity share one of these.

    ``common`` is sorted and ``rank`` has its places in the order; the other shingles come before, by their hashes."""
    n = len(shingles)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        late = common[at] == shingles
        shingles = np.concatenate((shingles[~late], shingles[late][np.argsort(rank[at[late]])]))
    return shingles[: min(n, n - math.ceil(similarity * n - SLACK) + 1)]


def _firsts(docs: DataFrame, size: int, similarity: float, common: np.ndarray) -> DataFrame:
    """(k, n, first) of (k, text): the number of shingles and the first ones, for texts that can be similar to others."""
    rank = np.argsort(common)
    common = common[rank]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words_of(t), size) for t in texts_of(batch, "text")]
        some = np.flatnonzero([len(s) > 1 for s in sets])
        first = [first_shingles(sets[i], similarity, common, rank).view(np.int64) for i in some]
        sizes = pa.array([len(sets[i]) for i in some], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(some)), sizes, pa.array(first, pa.list_(pa.int64()))], ["k", "n", "first"])

    schema = docs.select("k").withColumns({"n": F.lit(0).cast("bigint"), "first": F.lit(None).cast("array<bigint>")}).schema
    return map_batches(docs, run, schema)


def _apart(keys: np.ndarray, nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, places: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Whole buckets sorted by key to all pairs, as rows of two nodes, of other groups that sizes and places allow.

    If it is the first shingle that two sets share, no more can follow it than stand behind it in both."""
    share = similarity / (1 + similarity)

    def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = sizes[i], sizes[j]
        can = (groups[i] != groups[j]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK)
        can &= np.minimum(n - places[i], m - places[j]) >= share * (n + m) - SLACK
        return np.stack((nodes[i[can]], nodes[j[can]]), axis=1)

    cut = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
    bucket = np.repeat(np.arange(len(starts)), stops - starts)
    rows = np.flatnonzero(((stops - starts > 1) & (stops - starts <= AT_ONCE))[bucket])
    for step in range(1, AT_ONCE):
        i, j = rows[:-step], rows[step:]
        same = bucket[i] == bucket[j]
        if not same.any():
            break
        yield pairs(i[same], j[same])
    for b in np.flatnonzero(stops - starts > AT_ONCE):
        rows = np.arange(starts[b], stops[b])
        names, counts = np.unique(groups[rows], return_counts=True)
        # rows of the largest group, which needs no pairs within, come last and are only met by the others
        most = groups[rows] == names[counts.argmax()]
        rows, others, held = np.concatenate((rows[~most], rows[most])), int((~most).sum()), [np.zeros((0, 2), np.int64)]
        for i in range(others):
            held.append(pairs(rows[i : i + 1].repeat(len(rows) - i - 1), rows[i + 1 :]))
            if sum(map(len, held)) > HELD_PAIRS:
                yield np.concatenate(held)
                held = held[:1]
        yield np.concatenate(held)


def _meeting(similarity: float):
    """Rows (key, node, component, n, place) sorted by key to pairs (a, b) of nodes in different components."""
    names = ("key", "node", "component", "n", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for pairs in _apart(*columns, similarity):
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

        # of the bucket that may go on
        held = [[np.zeros(0, np.int64)] for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [np.asarray(batch.column(c)) for c in names]
            done = int(np.searchsorted(more[0], more[0][-1]))
            if done or (len(held[0][-1]) and held[0][-1][-1] != more[0][0]):
                yield from out([np.concatenate((*h, m[:done])) for h, m in zip(held, more)])
                held = [[m[done:]] for m in more]
            else:
                held = [[*h, m] for h, m in zip(held, more)]
        columns = [np.concatenate(h) for h in held]
        if len(columns[0]):
            yield from out(columns)

    return run


def remaining(docs: DataFrame, nodes: DataFrame, linked: DataFrame, size: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) that hold all pairs at the similarity but those in one component of ``linked`` (node, component).

    ``docs`` has k and text, ``nodes`` has node and k."""
    some = F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0
    seen = docs.where(some).join(nodes.where(some).select("k"), "k", "left_semi").dropDuplicates(["k"])
    # one collected order for all tasks, whichever shingles the sample shows to be common
    firsts = _firsts(docs, size, similarity, common_shingles(seen.select("text"), size)).dropDuplicates(["k"])
    named = nodes.select("node", "k").join(linked, "node", "left").select("node", "k", F.coalesce("component", "node").alias("component"))
    rows = firsts.join(named, "k").select("node", "component", "n", F.posexplode("first").alias("place", "key"))
    rows = rows.select("key", "node", "component", "n", F.col("place").cast("bigint").alias("place"))
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_meeting(similarity), "a bigint, b bigint")
    return cut_lineage(met.distinct())


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but those that sizes and parities show to be below the similarity; ``nodes`` has node, size and parity."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in ("a", "b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, m = (np.asarray(batch.column(c)) for c in ("n_a", "n_b"))
        can = np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK
        most = (1 - similarity) / (1 + similarity) * (n + m) + SLACK
        p, q = batch.column("p_a"), batch.column("p_b")
        for i in np.flatnonzero(can):
            can[i] = least_difference(p[i].as_py(), q[i].as_py()) <= most[i]
        return batch.select(["a", "b"]).filter(pa.array(can))

    return map_batches(pairs.join(left, "a").join(right, "b"), run, "a bigint, b bigint")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(words_of(t), size).view(np.int64) for t in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return map_batches(texts, run, "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    near = (small >= F.lit(similarity) * large) & (shared >= F.lit(similarity) * (small + large - shared))
    return both.where(near).select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) at the similarity; ``docs`` has k and text, ``nodes`` has node, k, size and parity."""
    some = cut_lineage(likely(pairs, nodes, similarity))
    met = some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
    wanted = cut_lineage(nodes.select("node", "k").join(met, "node", "left_semi"))
    texts = docs.join(broadcast_if_small(wanted), "k").select("node", "text")
    sets = cut_lineage(_sets(texts, size).dropDuplicates(["node"]))
    return cut_lineage(verified(some, sets, similarity))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group: the one with the smallest id, then text hash.

    Texts with the same words (A-Z in any case, split at ASCII white space) are one group; groups are joined by
    pairs whose sets of ``words``-word shingles reach the Jaccard similarity, directly or through others.

    Fixed results: null and word-free texts are one group; a text of at most ``words`` words has only its equals; ids that
    are null come last in the order; rows equal in id and text count as one; an empty table gives no rows; other columns go along
    whatever their names are.
    """
    key = F.struct(F.col(doc_id).isNull().alias("n"), F.coalesce(F.col(doc_id), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))
    keyed = docs.select(key.alias("k"), F.col(text).alias("text"))
    classes = _described(keyed, words).groupBy("h1", "h2").agg(F.min("k").alias("k"), *[F.first(c).alias(c) for c in ("size", "print", "parity")])
    nodes = cut_lineage(classes.select(F.monotonically_increasing_id().alias("node"), "k", "size", "print", "parity"))
    prints = nodes.where("print is not null")
    pairs = cut_lineage(ring_pairs(prints).unionByName(candidates(prints, similarity)).distinct())
    linked = cut_lineage(components(_linked(pairs, keyed, prints, words, similarity)))
    more = _linked(remaining(keyed, prints, linked, words, similarity), keyed, prints, words, similarity)
    if not more.isEmpty():
        linked = components(linked.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    groups = cut_lineage(linked.join(nodes.select("node", "k"), "node"))
    first = groups.groupBy("component").agg(F.min("k").alias("first")).select("first")
    gone = cut_lineage(groups.select("k").join(first, F.col("k") == F.col("first"), "left_anti"))
    mark = fresh(docs.columns, "keep_key")
    kept = nodes.select(F.col("k").alias(mark)).join(gone.withColumnRenamed("k", mark), mark, "left_anti")
    return docs.withColumn(mark, key).join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
