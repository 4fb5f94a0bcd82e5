"""Shard tree, link trust, chat parts, WARC, curve search and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from checks import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import bpe, chat_parts, curve_search, decontaminate, language_mix, link_trust, queries, shard_tree, warc
from loomtext.session import work_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


def test_shards(spark):
    rows = [(i, "t" * (i % 50)) for i in range(4000)] + [(None, None), (7, "é"), (7, "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("SHARD", F.lit("x")).repartition(5)
    got = shard_tree.assign(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350
    moved = sum(r.grown_shard == 16 for r in got)
    assert 160 < moved < 320
    assert shard_tree.assign(docs.where("false")).collect() == []
    one = shard_tree.assign(docs, shards=1, base=1).collect()
    assert {r.shard for r in one} == {0} and {r.grown_shard for r in one} <= {0, 1}


def test_weights_confine_movement(spark):
    """A shard that doubles takes rows; rows move only on the path whose weights grew."""
    ids = spark.range(3000)
    before, after = shard_tree.tree(16), shard_tree.tree(16, weights={5: 2.0})
    moved = ids.select(shard_tree.shard_of(F.col("id"), before).alias("a"), shard_tree.shard_of(F.col("id"), after).alias("b")).where("a != b").collect()
    region = lambda s: s // 8
    assert moved and all(region(r.b) == region(5) for r in moved)
    assert all(r.b // 4 == 5 // 4 for r in moved if region(r.a) == region(5)) and all(r.b == 5 for r in moved if r.a // 4 == 5 // 4)
    nothing = shard_tree.tree(16, weights={3: 0.0})
    assert 3 not in {r[0] for r in ids.select(shard_tree.shard_of(F.col("id"), nothing)).distinct().collect()}


URLS = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1"), ("https://example.org", "example.org", ""), ("x://y.org/en/12#t", "y.org", "/en/12"),
    (None, "", ""), ("no scheme", "", ""), ("http://", "", ""), ("http://h.com?q=/de/", "h.com", ""), ("http://notorg/", "notorg", "/"), ("a://b://c/d", "b:", "//c/d"),
]


@pytest.mark.parametrize("few", [256, 0])
def test_urls_and_rules(spark, few):
    pages = spark.createDataFrame([(i, u, None) for i, (u, _, _) in enumerate(URLS)] * 2, "page_id int, url string, html string").withColumn("rule", F.lit(1))
    got = link_trust.judge(pages, queries.RULES, few=few).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path) == URLS[r.page_id][1:]
        fits = [(h + p, v) for v, h, p in queries.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        assert (r.rule, r.verdict) == best
    assert link_trust.judge(pages.where("false"), queries.RULES, few=few).collect() == []


def test_propagation(spark):
    """Ranks equal the power iteration on a dense matrix; distrust runs against links."""
    rules = [("allow", "good", "/"), ("block", "bad", "/")]
    link = lambda *hosts: " ".join(f'<a HREF="//{h}/x">' for h in hosts) + ' <a href="/own">'
    graph = {"good": ["mid", "mid", "far"], "mid": ["far"], "farm": ["bad", "farm2"], "farm2": ["farm"], "bad": ["far"], "far": []}
    rows = [(k, f"http://{h}/p", link(*to)) for k, (h, to) in enumerate(graph.items())]
    got = {r.host: r for r in link_trust.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), rules).collect()}
    hosts = list(graph)
    out = np.array([[to.count(h) for h in hosts] for to in graph.values()], float)
    for kind, seed, matrix in (("trust", "good", out), ("distrust", "bad", out.T)):
        share = matrix / np.maximum(matrix.sum(1, keepdims=True), 1)
        base = np.array([0.15 * (h == seed) for h in hosts])
        v = base
        for _ in range(20):
            v = base + 0.85 * v @ share
        assert np.allclose([got[h][kind] for h in hosts], v)
    assert {h: got[h].verdict for h in hosts} == {"good": "allow", "mid": "allow", "farm": "block", "farm2": "block", "bad": "block", "far": "allow"}


def messages(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    return frame.select("conv_id", "turn", "role", chat_parts.text_part(F.col("text")).alias("parts"))


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|im_start|>assistant", "<\\\\|", "a\nb\n", "", "<|image|>", "é😀<", "|><||<|", "\\", "$1\\1"]
    rows = [(1, k, r, t) for k, t in enumerate(nasty) for r in ("user", "assistant")]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (2, 0, "assistant\n<|x\\n", "odd role"), (None, 3, "assistant", "x"), (2, 1, "user", "same"), (2, 1, "user", "same")]
    back = {r.conv_id: r for r in chat_parts.read_back(chat_parts.format_conversations(messages(spark, rows))).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv in (1, 2, None):
        want = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        got = [(t.role, t.text) for t in back[conv].turns]
        assert sorted(got) == sorted(want)
        assert back[conv].loss_text == "".join(t for r, t in got if r == "assistant")
        for s in back[conv].loss:
            assert s.start + s.length <= len(back[conv].formatted)
    want2 = [(r or "", t or "") for _, _, r, t in sorted([x for x in rows if x[0] == 2], key=order)]
    assert [(t.role, t.text) for t in back[2].turns] == want2
    assert chat_parts.format_conversations(messages(spark, rows).where("false")).collect() == []


def test_chat_attachments(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [
        (1, 0, "user", [part("text", "look "), part("image", ref="a.png"), part("document", ref="d.pdf", tokens=9)]),
        (1, 1, "assistant", [part("text", "I see <|image|> "), part("audio", ref="x.wav"), part("text", "end")]),
        (1, 2, "user", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat_parts.PART}>")
    r = chat_parts.read_back(chat_parts.format_conversations(frame)).first()
    assert r.formatted.startswith("<|im_start|>user\nlook <|image|><|document|><|im_end|>\n")
    assert [(a.kind, a.ref, a.turn, a.tokens) for a in r.attachments] == [("image", "a.png", 1, 256), ("document", "d.pdf", 1, 9), ("audio", "x.wav", 2, 128)]
    assert r.expanded_tokens == 393 and r.loss_text == "I see <|image|> end"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss] == ["I see <\\|image|> ", "end"]
    assert [(t.role, t.text) for t in r.turns] == [("user", "look "), ("assistant", "I see <|image|> end"), ("user", "")]


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\u2028é"
    rows = [(3, "http://h/p?q#f", tricky), (1, "http://h/2", tricky), (2, None, None), (5, "http://x/\r\ny", ""), (4, "http://z", "solo"), (1, "http://h/2", tricky), (None, "u", "solo"), (None, "v", "void")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(0))
    path = work_path(spark, "test-archives")
    warc.write_archives(pages, path, file_captures=2)
    got = warc.assemble(spark, path).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    low = {digest(tricky): 1, digest(""): 2, digest("solo"): 4}
    want = []
    for i, _, t in rows:
        first = low.get(digest(t))
        again = first is not None and i != first
        want.append((str(i), len((t or "").encode()), digest(t), "revisit" if again else "response", str(first if again else None), b"" if again else (t or "").encode()))
    assert sorted((str(r.page_id), r.payload_bytes, r.digest, r.kind, str(r.refers_to), bytes(r.payload or b"")) for r in got) == sorted(want)
    assert all(r.request.first_line.startswith("GET /") for r in got) and all(r.metadata for r in got)
    raw = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    kinds = Counter(f["warc-type"] for x in raw for f, _ in warc.records_of(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(bytes(x.content))))))
    assert kinds == {"request": 8, "metadata": 8, "response": sum(w[3] == "response" for w in want), "revisit": sum(w[3] == "revisit" for w in want)}
    least = work_path(spark, "test-archives")
    warc.write_archives(pages, least, least=5)
    assert Counter(r.kind for r in warc.assemble(spark, least, payloads=False).collect()) == {"response": 7, "revisit": 1}
    empty = work_path(spark, "test-archives")
    warc.write_archives(pages.where("false"), empty)
    assert warc.assemble(spark, empty).collect() == []


def test_warc_reader_edges():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.records_of(io.BytesIO(one * 2))] == [b"abcd"] * 2
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(one[:-6])))
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(b"junk\r\n")))


def test_hilbert_neighbours():
    """Each cell once, and consecutive places are neighbouring cells."""
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = curve_search.hilbert(grid, bits)
        order = grid[np.argsort(keys)].astype(int)
        assert sorted(keys.tolist()) == list(range(len(grid))) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def slow_search(rows, is_query, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = {}
    for q, x in ok:
        if is_query(q):
            near = sorted(((-float(x @ v), i) for i, v in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def test_search_of_few_rows_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=6) * rng.uniform(0.2, 3)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None] + [0.0] * 4), (303, [math.nan] * 6), (None, rows[1][1]), (304, [math.inf] + [0.0] * 5), (20, rows[20][1]), (305, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(0))
    got = {}
    for r in curve_search.search(frame, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = slow_search(rows, lambda i: i % 20 == 0, 7)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))
    assert curve_search.search(frame.where("false"), F.lit(True)).collect() == []
    uneven = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="from 2 to 4"):
        curve_search.search(uneven, F.lit(True))
    assert curve_search.search(frame.where("vec_id = 20"), F.lit(True)).collect() == []


def test_search_recall(spark):
    """Windows that see a tenth of the rows per curve find at least nine of ten."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    data = (centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")
    got = curve_search.search(frame, F.col("vec_id") % 50 == 0, curves=16, window=100).toPandas()
    hit = 0
    for q, part in got.groupby("query_id"):
        s = data.astype(float) @ data[q].astype(float)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(part.vec_id))
    assert len(got) == 60 * 20 and hit / len(got) >= 0.9


def test_search_meets_a_share_of_any_table(spark, monkeypatch):
    """The share of ranks that a query meets does not fall with the table, blocks stay small, and split ones lose nothing."""
    for ranks in (51_200, 200_000, 3_000_000, 200_000_000):
        block, reach, parts = curve_search.layout(ranks, ranks // 20)
        assert (2 * reach + 1) * block >= 0.03 * ranks and block <= curve_search.BLOCK
        assert (2 * reach + 1) * block / 20 <= parts * curve_search.QUERIES
    assert curve_search.layout(1_000, 50) == (512, 1, 1)
    monkeypatch.setattr(curve_search, "BLOCK", 20)
    monkeypatch.setattr(curve_search, "QUERIES", 7)
    monkeypatch.setattr(curve_search, "FAN", 5)
    rng = np.random.default_rng(8)
    points = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(points.tolist())], "vec_id bigint, embedding array<double>")
    assert curve_search.layout(330, 30, 300) == (20, 22, 5)
    got: dict[int, list[int]] = {}
    for r in curve_search.search(frame, F.col("vec_id") % 10 == 0, k=9, curves=2, window=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [int(i) for i in np.argsort(-(points @ points[q])) if i != q][:9] for q in range(0, 300, 10)}


def test_pipeline(spark, codec_args):
    """Each stage alone: what goes and what stays; then the whole."""
    passage = " ".join(f"t{i}" for i in range(14))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    sf = work_path(spark, "test-tables")
    items.write.parquet(f"{sf}/benchmark.parquet")
    body = [" ".join(f"w{(k * 7 + i * i) % 97}" for i in range(80)) for k in range(8)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(body)]
    rows += [(20, body[3] + "  ", "en", "s", 1), (21, passage, "en", "s", 1), (22, None, None, None, None), (23, "12 34", "en", None, 1), (None, "kept without id", None, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{sf}/documents.parquet")
    ids = lambda d: sorted((r.doc_id is None, r.doc_id or 0) for r in d.collect())
    named = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark", "tokens"]
    for name, gone in (("language", {22, 23}), ("near_copies", {20}), ("benchmark", {21})):
        out = named[name](spark, docs, sf)
        assert out.columns == docs.columns
        assert ids(out) == [x for x in ids(docs) if not (not x[0] and x[1] in gone)], name
    out = corpus_pipeline.run(spark, sf).collect()
    texts = {i: t for i, t, *_ in rows}
    assert {r.doc_id for r in out} == set(range(8)) | {None} and len(out) == 9
    whole = bpe.codec(*codec_args).encoding
    assert all(r.exact and r.ids == whole.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == [], name


def test_pipeline_by_hand(spark):
    """The pipeline over the test tables against its stages' rules, each by brute force on what the one before kept."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {i: t for i, t in docs.items() if language_mix.has_letter(t)}
    words = {i: t.encode().lower().split() for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    order, root = sorted(kept), {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(order):
        for b in order[:n]:
            shared = len(sets[a] & sets[b])
            if 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    items = [(str(r.item_id), (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = decontaminate.Windows(items)
    for i, t in list(kept.items()):
        n, marks, _ = windows.scan(t.encode())
        if marks.sum() and 20 * marks.sum() >= n:
            del kept[i]
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(kept) and all(r.exact for r in out)


def test_no_python_in_native_operators(spark):
    for name in ("op5_shard_tree", "op9_link_trust", "op10_chat_parts"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name
