"""Whitening, ball codes and packing against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import ball_codes, packing, whitening

SF = "/root/testdata/sf0.001"
ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
UNUSABLE = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, None), (903, [float("inf")] + [0.0] * 7, None)]


def vectors(n=300, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    made = rng.normal(0.2, 0.5, (n, dims)) * np.linspace(1, 3, dims)
    made[n // 2 : n // 2 + 40] = made[0]  # copies
    return [(int(i), [float(np.float32(c)) for c in row], None if i % 7 == 0 else int(i % 3)) for i, row in enumerate(made)]


def whole(rows, shift=0):
    return [[int(np.floor(1024 * c)) + shift for c in v] for _, v, _ in rows]


def test_whitening_by_hand(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + UNUSABLE + [rows[5]], ROWS).withColumn("Deviation", F.lit("x")).repartition(5)
    white, model, error = whitening.whiten_rows(df, components=3)
    x = whole([*rows, rows[5]], 100_000)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = [[n * c - s for c, s in zip(v, sums)] for v in x]
    cov = np.array([[float(Fraction(sum(v[a] * v[b] for v in centred), n**3)) for b in range(8)] for a in range(8)])
    values, directions = np.linalg.eigh(cov)
    want = np.array(centred) / n @ directions[:, ::-1][:, :3] / np.sqrt(values[::-1][:3])
    got = sorted((r.vec_id, int(r.deviation), *np.round(np.abs(r.whitened), 9)) for r in white.collect())
    assert got == sorted((i, sum(d * d for d in v), *np.round(np.abs(w), 9)) for (i, _, _), v, w in zip([*rows, rows[5]], centred, want))
    assert model.n == n and error < 1e-9
    assert np.allclose(model.explained, values[::-1][:3] / values.sum(), rtol=1e-12)
    assert {c.lower() for c in white.columns} == {"vec_id", "label", "deviation", "whitened"}


def test_square_sums_are_exact():
    u = np.array([[3, -4], [1 << 40, -(1 << 41)], [5, 1 << 33]])
    assert whitening.square_sums(u, np.array([0]), np.array([1])) == [sum((int(a) + int(b)) ** 2 for a, b in u)]


def test_whitening_without_components(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25], 1)], ROWS)
    assert whitening.fit(spark.createDataFrame([], ROWS)) is None
    assert whitening.fit(one) is None  # a single vector has no variance
    assert whitening.fit(spark.createDataFrame([(1, [], 1)], ROWS)) is None
    flat = spark.createDataFrame([(i, [float(i), float(i), 1.0], 1) for i in range(20)], ROWS)
    assert len(whitening.fit(flat).variances) == 1  # equal and constant dimensions bring none of their own
    with pytest.raises(ValueError):
        whitening.fit(one.union(spark.createDataFrame([(2, [1.0], 1)], ROWS)))


def slow_codes(x, parts, entries, rounds):
    """Plain k-means over whole numbers, every part against every entry."""
    width = len(x[0]) // parts
    cut = [[v[k * width : (k + 1) * width] for v in x] for k in range(parts)]
    far = lambda p, e: sum((a - b) ** 2 for a, b in zip(p, e))
    near = lambda p, book: min(range(len(book)), key=lambda i: (far(p, book[i]), i))
    books = [ps[:entries] for ps in cut]
    for _ in range(rounds):
        for k in range(parts):
            held = {}
            for p in cut[k]:
                held.setdefault(near(p, books[k]), []).append(p)
            books[k] = [[sum(c) // len(held[i]) for c in zip(*held[i])] if i in held else e for i, e in enumerate(books[k])]
    codes = [[near(p, books[k]) for p in cut[k]] for k in range(parts)]
    error = [sum(far(cut[k][i], books[k][codes[k][i]]) for k in range(parts)) for i in range(len(x))]
    return ["".join(f"{codes[k][i]:02x}" for k in range(parts)) for i in range(len(x))], error, books


@pytest.mark.parametrize("entries,rounds,spread", [(16, 4, 1), (5, 1, 1), (256, 2, 1), (16, 3, 40_000)])
def test_ball_codes_are_those_of_plain_k_means(spark, entries, rounds, spread):
    """Also with components too large for doubles, repeated rows and ids, and fewer rows than entries."""
    rows = [(i, [c * spread for c in v], label) for i, v, label in vectors(200)]
    rows += [(3, rows[9][1], 1), (3, rows[9][1], 1)]
    df = spark.createDataFrame(rows + UNUSABLE, ROWS).withColumn("CODE", F.lit("x")).repartition(4)
    coded, books = ball_codes.compress(df, entries=entries, rounds=rounds)
    coded = ball_codes.with_group_error(coded, "label", "label_error")
    x = whole(spark.createDataFrame(rows, ROWS).collect())
    # the first entries go by id, repeated ids by vector
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))
    codes, error, slow_books = slow_codes([x[i] for i in order], 4, entries, rounds)
    groups = Counter()
    for i, e in zip(order, error):
        groups[rows[i][2]] += e
    want = sorted((rows[i][0], c, e, groups[rows[i][2]]) for i, c, e in zip(order, codes, error))
    assert sorted((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in coded.collect()) == want
    assert [b.tolist() for b in books] == slow_books
    text = ",".join(str(c) for b in slow_books for e in b for c in e)
    assert ball_codes.digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_balls_skip_work_and_lose_nothing():
    """Far clusters: parts in the core meet no other entry, and the answer is that of all entries."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-4000, 4000, (40, 6))
    points = np.concatenate([m + rng.integers(-30, 30, (50, 6)) for m in middles])
    codes = np.repeat(np.arange(40), 50)
    far = np.sqrt([ball_codes.own_squares(points[codes == i], middles[codes[codes == i]]).max() for i in range(40)])
    balls = ball_codes.make_balls(middles, far)
    assert sum(map(len, balls.neighbours)) < 40
    assert (ball_codes.reassign(points, codes, balls) == codes).all()
    unknown = ball_codes.make_balls(middles, np.full(40, np.inf))
    assert (ball_codes.reassign(points, np.zeros(len(points), int), unknown) == ball_codes.squares(points, middles).argmin(axis=1)).all()


def test_ball_codes_of_odd_tables(spark):
    empty, books = ball_codes.compress(spark.createDataFrame([], ROWS))
    assert empty.collect() == [] and set(empty.columns) == {"vec_id", "label", "code", "error"}
    with pytest.raises(ValueError):
        ball_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], ROWS))
    coded, _ = ball_codes.compress(spark.createDataFrame([(None, [1.0] * 4, None)], ROWS))
    assert [(r.vec_id, r.error) for r in coded.collect()] == [(None, 0)]


ODD = [None, "", "   \n", "don't STOP, it's 12 ½ µm — ÄÖÜß", "<|endoftext|> a<|startoftext|>b", "x\x1cy\x85z\xa0w", "İstanbul ǅ Σς é ́", "b" * 5000, "!?...;'sabc", "naïve,caf\xe9. \xd7\xf7", "emoji 😀🎉 中文 текст"]


def test_pieces_are_the_tokenizer_s(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    words = ["the", "The", "of,", "don't", "ÉTÉ!", "12", "½", "zqx", "--", "a.b", "(x)", "\t"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(30)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit(1)).repartition(3)
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in packing.token_pieces(docs, path, 16, 0).collect())
    whole_text, want = Tokenizer.from_file(path), []
    for i, t in rows:
        ids = [*whole_text.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 16)):
            cut = ids[at : at + 16]
            want.append((str(i), k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut)))
    assert got == sorted(want)


@pytest.mark.parametrize("size,n,seed", [(32, 3000, 1), (100, 5000, 2), (2048, 4000, 3), (64, 10, 4)])
def test_plan_holds_every_piece_once(size, n, seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(np.log(size / 4), 1.0, n).astype(int), 1, size)
    histogram = Counter(lengths.tolist())
    histogram[size // 3] += n // 2  # one length with a third of all pieces
    runs, held = packing.plan(dict(histogram), size), Counter()
    for run in runs:
        assert run.times > 0 and sum(length * each for length, each in run.fill) <= size
        for length, each in run.fill:
            held[length] += each * run.times
    assert held == histogram
    bound = -(-sum(k * v for k, v in histogram.items()) // size)
    fitted = len(packing.best_fit(np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)]), size))
    assert bound <= sum(r.times for r in runs) <= max(fitted, bound) + max(1, bound // 500)


def test_best_fill_is_the_best():
    rng = np.random.default_rng(7)
    for _ in range(30):
        lengths = np.sort(rng.choice(np.arange(1, 15), 4, replace=False))
        left, price = rng.integers(1, 4, 4), rng.random(4)
        value, pieces = packing.best_fill(lengths, left, price, 20)
        counts = np.stack(np.meshgrid(*[np.arange(m + 1) for m in left]), -1).reshape(-1, 4)
        for room in (0, 7, 20):
            fits = counts[counts @ lengths <= room]
            assert np.isclose((fits @ price).max(), value[room])
            fill = pieces(room)
            assert sum(lengths[i] * k for i, k in fill.items()) <= room and all(k <= left[i] for i, k in fill.items())
            assert np.isclose(sum(price[i] * k for i, k in fill.items()), value[room])


def test_pack_places_rows(spark):
    rng = random.Random(9)
    rows = [(i, 0, 5 if i % 3 == 0 else rng.randint(1, 16)) for i in range(3000)] + [(7, 0, 5)] * 3 + [(None, 0, 16)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint").withColumn("OFFSET", F.lit("x")).repartition(7)
    got = packing.pack(df, 16).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter(rows)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 16
    assert sorted(filled) == list(range(len(filled)))
    assert len(filled) <= -(-sum(r[2] for r in rows) // 16) + 2
    assert packing.pack(df.limit(0), 16).collect() == []
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 17)], "doc_id bigint, piece int, length bigint"), 16)
