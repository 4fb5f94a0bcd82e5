"""Near copies by wide SimHashes, against brute force over whole shingle sets."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import near_copies


def jaccard(a, b):
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def shingles(text, size=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def texts(rng, families, copies, words=220):
    """Texts of common words; families of copies with one to six words changed or a piece left out."""
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=words)
        out.append(" ".join(base))
        for _ in range(copies):
            changed = list(base)
            if rng.random() < 0.3:
                at = rng.randrange(words - 30)
                del changed[at : at + rng.randrange(1, 30)]
            for _ in range(rng.randrange(1, 7)):
                changed[rng.randrange(len(changed))] = rng.choice(vocabulary)
            out.append(" ".join(changed))
    return out


def groups(sets):
    """Smallest place of each group, and the pairs at the similarity."""
    root, pairs = list(range(len(sets))), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = defaultdict(list)
    for i, s in enumerate(sets):
        met = {j for x in s for j in by_shingle[x]}
        for x in s:
            by_shingle[x].append(i)
        for j in met:
            if jaccard(s, sets[j]) >= 0.8:
                pairs.append((j, i))
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))], pairs


def test_recall_and_no_false_link(spark):
    rng = random.Random(11)
    rows = texts(rng, 120, 3) + texts(rng, 300, 0)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    root, pairs = groups([shingles(t) for t in rows])
    kept = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    firsts = {i for i, r in enumerate(root) if i == r}
    changed = len(rows) - len(firsts)
    assert changed > 150 and len(pairs) > 200
    assert firsts <= kept, "a text without an earlier near copy stays"
    assert len(kept - firsts) <= 0.1 * changed


def test_pairs_below_the_similarity_are_not_linked(spark):
    words = [f"v{i}" for i in range(104)]
    near, far = list(words), list(words)
    near[50] = "x"  # 95 of 105 shingles
    for i in (20, 40, 60):  # 85 of 115 shingles
        far[i] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == [1, 3]
    # the two that share 3 of 4 words' shingles meet at a lower similarity
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, similarity=0.6).collect()) == [1]
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a bigint, b bigint")
    sets = near_copies._sets(docs.withColumnRenamed("doc_id", "node"), 5)
    assert [tuple(r) for r in near_copies.verified(pairs, sets, 0.8).collect()] == [(1, 2)]


def test_a_large_family_sends_few_rows(spark):
    """Copies that differ in one word each stand behind one another before the shuffle."""
    base = [f"u{i}" for i in range(400)]
    rows = []
    for i in range(600):
        changed = list(base)
        changed[i % 400] = f"z{i}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
    sets = [near_copies.shingle_set(near_copies.words_of(t.encode()), 5) for _, t in rows]
    codes = np.array([np.frombuffer(near_copies.wide_print(s)[:16], np.uint64) for s in sets])
    edges, own = near_copies._bucket(codes, near_copies.budget(0.8))
    assert len(own) < 60 and len(edges) <= near_copies.NEAREST * len(rows)


def test_edge_rows(spark):
    long_text = " ".join(f"l{i % 5000}" for i in range(200_000))
    rows = [
        (5, "a b c d e f", 1),
        (2, "A b  c d e f ", 2),
        (2, "A b  c d e f ", 3),
        (None, "a b c d e f", 4),
        (None, "alone in the wood", 5),
        (7, "alone in the", 5),
        (9, None, 6),
        (8, " \t", 7),
        (3, long_text, 8),
        (4, long_text + " end", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, NODE int").withColumnRenamed("NODE", "Print")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 7), (False, 8), (True, 0)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_copies.keep_one(empty).collect() == []


@pytest.mark.parametrize("count", [10, 100_000, 10**9])
def test_keys_follow_the_rows(count):
    width, keys = near_copies.key_plan(count, 0.8)
    assert 2**width >= 2 * count and keys * (1 - near_copies.bit_share(0.8)) ** width >= near_copies.SHARED_KEYS
    weights = near_copies._weights(width, min(keys, 50))
    assert (np.count_nonzero(weights, axis=0) == width).all() and weights.sum(axis=0).max() < 2**48


def test_the_ring_proposes_all_within_its_distance(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(256) for _ in range(200)]
    prints = []
    for x in base:
        places = rng.sample(range(192, 256), 5)  # the first 64 bits
        prints += [x, x ^ 1, x ^ sum(1 << p for p in places[:4]), x ^ sum(1 << p for p in places)]
    rows = [(i, x.to_bytes(32, "big")) for i, x in enumerate(prints)]
    pairs = {tuple(r) for r in near_copies.ring_pairs(spark.createDataFrame(rows, "node bigint, print binary")).collect()}
    distance = lambda a, b: ((prints[a] ^ prints[b]) >> 192).bit_count()
    assert all(a < b and distance(a, b) <= 4 for a, b in pairs)
    # the four prints of a family: two equal in these bits, one at four of them, one at five and at one from that
    for k in range(0, len(prints), 4):
        assert {(k, k + 1), (k, k + 2), (k + 2, k + 3)} <= pairs
    assert len(pairs) == 600


def change(words, places, tag):
    """The words with some places changed; places five apart change five shingles each."""
    return [f"{tag}{i}" if i in places else w for i, w in enumerate(words)]


def test_every_group_is_found(spark):
    """Pairs just above the similarity, links that only a close copy has, and a passage that most texts have."""
    rng = random.Random(5)
    rows = []
    for k in range(400):  # 90 of 110 shingles
        base = [f"p{k}a{i}" for i in range(104)]
        rows += [base, change(base, {20, 60}, f"p{k}b")]
    for k in range(100):  # 395 of 405, 360 of 440, and 355 of 445 between the first and the last
        base = [f"t{k}a{i}" for i in range(404)]
        close = change(base, {200}, f"t{k}b")
        rows += [base, close, change(close, set(range(10, 170, 20)), f"t{k}c")]
    passage = [f"c{i}" for i in range(100)]
    for k in range(150):
        own = [f"o{rng.randrange(40)}" for _ in range(rng.randrange(4, 40))]
        rows.append(own + passage if k % 2 else passage + own)
    rows = [" ".join(r) for r in rows]
    root, pairs = groups([shingles(t) for t in rows])
    assert len(pairs) > 600 and len({root[i] for i in range(1100, len(rows))}) > 10
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {i for i, r in enumerate(root) if i == r}


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_all_pairs_of_other_groups_meet(step):
    rng = random.Random(6)
    rows = []
    for key, size in enumerate([1, 2, 2, 3, 5, 31, 32, 33, 200, 1, 40, 2]):
        for _ in range(size):
            n = rng.randrange(80, 120)
            rows.append((key, len(rows), rng.choice([1, 1, 1, 1, 2, 3]) if size > 5 else len(rows), n, rng.randrange(n // 5 + 1)))
    most = lambda r: min(r[0][3] - r[0][4], r[1][3] - r[1][4])
    need = lambda r: 0.8 / 1.8 * (r[0][3] + r[1][3]) - 1e-6
    both = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and a[2] != b[2]]
    fit = sorted((a[1], b[1]) for a, b in both if 0.8 * max(a[3], b[3]) <= min(a[3], b[3]) + 1e-6 and most((a, b)) >= need((a, b)))
    names = ["key", "node", "component", "n", "place"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + step])], names) for i in range(0, len(rows), step)]
    got = [p for out in near_copies._meeting(0.8)(iter(batches)) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    assert 1000 < len(fit) < len(both) and sorted(got) == fit


def test_first_shingles_and_parities_hold_what_is_similar():
    rng = np.random.default_rng(7)
    pool = np.unique(rng.integers(0, 2**64, 3000, np.uint64))
    ranked = rng.permutation(pool)[:700]
    rank = np.argsort(ranked)
    for _ in range(400):
        base = rng.permutation(pool)[: rng.integers(2, 900)]
        cut = rng.integers(0, len(base) // 5 + 2)
        a, b = np.sort(base[cut:]), np.sort(base[: len(base) - rng.integers(0, 3)])
        shared = len(np.intersect1d(a, b))
        assert near_copies.least_difference(near_copies.parity(a), near_copies.parity(b)) <= len(a) + len(b) - 2 * shared
        if len(a) and len(b) and shared >= 0.8 * (len(a) + len(b) - shared):
            for common, places in ((ranked[rank], rank), (pool[:0], rank[:0])):
                first = [near_copies.first_shingles(s, 0.8, common, places) for s in (a, b)]
                assert len(np.intersect1d(*first))
    assert near_copies.least_difference(near_copies.parity(pool[:1000]), near_copies.parity(pool[1000:2000])) > 600
