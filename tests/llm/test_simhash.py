"""SimHash: fingerprints and links against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomtext.llm import components, simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def texts(rng, n):
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for t in base[: n // 2]:
        parts = t.split()
        parts[rng.randrange(len(parts))] = "changed"
        out += [" ".join(parts), t.upper() + " \n"]
    return out


def test_fingerprint_and_components(spark):
    rng = random.Random(1)
    all_texts = texts(rng, 40) + ["", None, "one", "Two  words", " \t"]
    rows = [(i * 3, t) for i, t in enumerate(all_texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    prints = {i: slow_print(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    want = slow_components(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4)
    assert {i: r.component_id for i, r in got.items()} == want


def test_native_hash_agrees(spark):
    text = "a bé c"
    native = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert native % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42) and simhash.fingerprint(text.encode()) == native


@pytest.mark.parametrize("bucket", [2081, 3])
def test_links_of_dense_and_planted_prints(spark, bucket):
    """All levels of keys give the same components; a small bucket forces the finer ones."""
    rng = random.Random(7)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            values.add(y)
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) for a in range(0, 40, 3)}
    for width in range(5):  # exactly four bits apart, in each pair of segments
        values |= {centre ^ 0xFF00FF00FF, centre ^ 0xFF00FF00FF ^ sum(1 << b for b in rng.sample(range(64), 4))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    got = {r.fp: r.component for r in simhash.near_duplicates(frame, bucket=bucket).collect()}
    want = slow_components(sorted(signed), lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 4)
    assert got == want


def test_keep_one(spark):
    rows = [(5, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 3), (None, "a b c d e f", 4), (None, "alone in the wood", 5), (9, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, FINGERPRINT int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r[0] is None, r[0] or 0, r[1] or "") for r in kept.collect()) == [(False, 2, "A b c d e f"), (False, 8, ""), (True, 0, "alone in the wood")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.simhash_components(docs).collect() == [] and simhash.keep_one(docs).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(3)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000 + i: 1000 for i in range(60)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
