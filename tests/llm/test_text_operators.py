"""BPE, decontamination, language mixture and language model against brute force."""

import copy
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import attention_lm, bpe, decontaminate, language_mix, queries

ODD = ["", None, " ", "\n\n  x", "don't  STOP\n\n\nnow  ", "ñandú — über 12345 ", "a" * 3000, "   " * 400, "x'rest 're 'll", "😀🎉 emoji\tand\r\nlines"]


def long_texts(seed=2):
    rng = random.Random(seed)
    parts = ["the", " ", "\n", "  ", "don't", "été", "123", "!!", "-", "'re", "\n\n", "word", "a" * 70, " " * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(200, 900))) for _ in range(12)]


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 10), (64, 32), (200, 16)])
def test_bpe_is_the_library_s(spark, codec_args, chunk, overlap):
    """Whatever the chunks, ids equal those of the whole text and decode to its bytes."""
    texts = ODD + long_texts()
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] + [(99, texts[-1])] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(docs, *codec_args, chunk=chunk, overlap=overlap), *codec_args)
    whole = bpe.codec(*codec_args).encoding
    want = sorted((str(i), whole.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in back.collect()) == want


def test_bpe_of_long_runs(spark, codec_args):
    """White space and words far longer than a chunk, which the library's own pattern engine can't take."""
    whole = bpe.codec(*codec_args).encoding
    n = 2_000_000
    # each text with its pre-tokens, known by hand
    cases = [["a", " " * (n - 1), " b"], ["\n" * (n - 1), "\n", "x"], ["\t \n" * (n // 3)], ["ab" * (3 * n // 4)], ["it", "'s", " short"]]
    rows = [(i, "".join(c), "x", "y") for i, c in enumerate(cases)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDS string, text_key string")
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, *codec_args), *codec_args).collect()}
    for i, case in enumerate(cases):
        assert back[i].ids == [t for token in case for t in whole._encode_single_piece(token)], i
        assert bytes(back[i].decoded) == "".join(case).encode() and back[i].text_key == "y"


def test_bpe_ranks_and_empty(spark, codec_args):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), *codec_args).collect() == []
    assert bpe.parse_ranks(b"YQ== 0\nYg== 1\n") == {b"a": 0, b"b": 1}


def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_hits(text, items, window=13):
    words, hit, owners = slow_words(text), set(), set()
    for item, body in items:
        w = slow_words(body)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit |= set(range(at, at + n))
                    owners.add(str(item))
    return len(words), sorted(hit), sorted(owners)


def benchmark_case(seed=4):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "abé" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "--"), (52, "Rare ONE word")]
    docs = []
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 2:
            at = rng.randrange(len(body) + 1)
            body[at:at] = rng.choice(items[:12])[1].upper().split()[: rng.choice([12, 13, 40])]
        docs.append((i, " - ".join(body) + ("; rare one, word" if i % 7 == 0 else "")))
    return items, docs + [(100, None), (100, ""), (None, items[0][1])]


@pytest.mark.parametrize("max_items", [100, 3])
def test_decontamination(spark, max_items):
    """Both ways, by broadcast and by join, find what a search of all windows finds."""
    items, docs = benchmark_case()
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.scan(*frames, max_items=max_items).collect()
    want = []
    for i, t in docs:
        n, hit, owners = slow_hits(t, items)
        want.append((str(i), n, hit, owners))
    assert sorted((str(r.doc_id), r.n_words, [w for s in r.spans for w in range(s.start, s.end)], r["items"]) for r in got) == sorted(want)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in got)


def test_decontamination_removes(spark):
    passage = " ".join(f"t{i}" for i in range(13))
    rows = [(1, f"Before, {passage.upper()}! after", "x"), (2, "clean", None), (3, None, "y"), (4, passage + " " + "w " * 400, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit string")
    items = spark.createDataFrame([(0, passage), (0, passage)], "item_id int, text string")
    assert decontaminate.remove_documents(docs, items).columns == docs.columns
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, items).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut == {1: "Before, ! after", 2: "clean", 3: None, 4: " " + "w " * 400}
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.remove_documents(docs, none).count() == 4
    assert decontaminate.scan(docs.select("doc_id", "text"), none, max_items=-1).count() == 4


def test_language_mixture(spark):
    rng = random.Random(5)
    words = {"aa": ["the", "and", "of", "thing"], "bb": ["der", "und", "schön", "nicht"], "cc": ["les", "été", "avec", "une"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(rng.choices(sorted(words), k=120))]
    docs = spark.createDataFrame(rows + [(500, None, "aa"), (501, "x", None)], "doc_id bigint, text string, lang string")
    model = language_mix.learn(docs, F.col("doc_id") % 5 != 0)
    assert model.languages == ["aa", "bb", "cc"]
    test = [(0, say("bb", 40), "b"), (1, say("aa", 30) + " " + say("cc", 10), "a"), (2, None, ""), (3, "12 -- 34", ""), (4, "", ""), (5, say("cc", 5000), ""), (5, say("cc", 3), "")]
    got = language_mix.identify(spark.createDataFrame(test, "doc_id int, text string, lang string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["bb", "aa", "und", "und", "und", "cc", "cc"]
    assert all(0 <= r.score <= 1 for r in got) and [r.score for r in got[2:5]] == [0, 0, 0]
    mix = {x.lang: x.share for x in got[1].mixture}
    assert set(mix) == {"aa", "cc"} and abs(mix["aa"] - 0.75) < 0.1
    nothing = language_mix.learn(docs.where("false"), F.lit(True))
    assert [r.lang_pred for r in language_mix.identify(docs.limit(3), nothing).collect()] == ["und"] * 3


def test_language_accuracy(spark):
    p = queries.queries()["op4_language_mixture"](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = p[p.held_out]
    assert len(p) == len(truth) and (held.lang_pred == truth.loc[held.doc_id].values).mean() > 0.97


def test_gradients_of_attention(monkeypatch):
    monkeypatch.setattr(attention_lm, "CLASSES", 5)
    model, rng = attention_lm.Attention(7, 1), np.random.default_rng(2)
    ids, targets = rng.integers(0, 7, (2, attention_lm.KEYS)), rng.integers(0, 5, (2, attention_lm.KEYS))
    valid = rng.random((2, attention_lm.KEYS)) < 0.7
    for n in model.NAMES:
        setattr(model, n, getattr(model, n).astype(np.float64))
    _, g = model.gradients(ids, targets, valid)
    for n in model.NAMES:
        w = getattr(model, n)
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-4
        up = model.gradients(ids, targets, valid)[0]
        w[at] -= 2e-4
        down = model.gradients(ids, targets, valid)[0]
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[n][at]) < 1e-4 + 0.02 * abs(g[n][at]), n


def attention_batch(windows, seed):
    """A batch as training has it: the positions before STRIDE are context only, the last window is short."""
    rng = np.random.default_rng(seed)
    ids, targets = rng.integers(0, 500, (windows, attention_lm.KEYS)), rng.integers(0, attention_lm.CLASSES, (windows, attention_lm.KEYS))
    valid = np.tile(np.arange(attention_lm.KEYS) >= attention_lm.KEYS - attention_lm.STRIDE, (windows, 1))
    valid[-1, -5:] = False
    return ids, targets, valid


def test_gradients_of_large_weights():
    """float32 gives what float64 gives, where exponents would overflow too."""
    for scale in (1, 60):
        model, batch = attention_lm.Attention(500, 1), attention_batch(40, 3)
        model.Wo, model.Wb, model.b = model.Wo * scale, model.Wb * scale, model.b + np.float32(scale)
        wide = copy.copy(model)
        for n in model.NAMES:
            setattr(wide, n, getattr(model, n).astype(np.float64))
        loss, g = model.gradients(*batch)
        true_loss, true = wide.gradients(*batch)
        assert np.isfinite(loss) and abs(loss - true_loss) < 1e-3 * true_loss
        for n in model.NAMES:
            assert g[n].dtype == np.float32 and abs(g[n] - true[n]).max() < 1e-3 * abs(true[n]).max(), (scale, n)


def test_gradients_hold_few_probabilities():
    """Class probabilities are held for ROWS positions at a time, in one place."""
    model, batch = attention_lm.Attention(500, 1), attention_batch(512, 4)
    model.gradients(*batch)
    tracemalloc.start()
    model.gradients(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # twice what all probabilities of the batch take in float32
    assert peak < 2 * batch[0].size * attention_lm.CLASSES * 4


def test_training_texts_are_encoded_once(spark, codec_args):
    """What is written gives back the ids of each text, with its hashes and characters."""
    sub = attention_lm.Subwords(*codec_args)
    rows = [(i, t) for i, t in enumerate(["", "One two  THREE", "x" * 300, "naïve 日本 \x0b a\tb", "one two"] * 300)]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    coded = attention_lm.encoded(texts, *codec_args, 7)
    found = sorted((r.near, r.chars, np.frombuffer(r.ids, sub.kind).tolist()) for r in coded.collect())
    near = {r.id: r.h for r in texts.select("id", F.xxhash64("id", "text", F.lit(7)).alias("h")).collect()}
    plain = lambda t: attention_lm.framed(np.array([i for w in t.encode().lower().split() for i in sub.of(w)], np.int32), sub).tolist()
    assert found == sorted((near[i], len(t), plain(t)) for i, t in rows)


def small_scorer(codec_args):
    sub = attention_lm.Subwords(*codec_args)
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5, (attention_lm.CONTEXTS, sub.size))
    classes = attention_lm._classes(counts.sum(0), np.zeros((0, attention_lm.KEYS + 1), np.int64), sub.end, 1)
    used = np.append(np.sort(rng.choice(sub.begin, 3000, replace=False)), [sub.begin, sub.end])
    rank = attention_lm.context_ranks(counts.sum(0))
    return attention_lm.Scorer(attention_lm.Attention(len(used), 3), used, sub, classes, counts, rank), sub


def test_windows_score_each_token_once(codec_args):
    """Batched windows give what one window for each token gives; probabilities of all subwords sum to one."""
    scorer, sub = small_scorer(codec_args)
    rng, lead = np.random.default_rng(1), attention_lm.KEYS - attention_lm.STRIDE
    texts = [attention_lm.framed(rng.integers(0, sub.begin, n).astype(np.int32), sub) for n in (0, 1, 23, 24, 25, 200)]
    got = scorer.score(texts)
    classes = np.zeros(attention_lm.CLASSES)
    for seq, value in zip(texts, got):
        total = 0.0
        for t in range(lead + 1, len(seq)):
            start = (t - lead - 1) // attention_lm.STRIDE * attention_lm.STRIDE
            ids = seq[start:t]
            ids = scorer.row[ids]
            x = scorer.table[ids] + scorer.place[0, : len(ids)]
            q, k, v = np.split(x, 3, axis=1)
            a = np.exp(k @ q[-1])
            logits = (a / a.sum()) @ v @ scorer.out + scorer.direct[ids[-1]]
            p = np.exp(logits - logits.max())
            classes = p / p.sum()
            total += np.log10(classes[scorer.classes[seq[t]]])
        assert abs(total - value) < 1e-3 * max(1, len(seq))
    for context in (0, 1, attention_lm.CONTEXTS - 1):
        mass = np.bincount(scorer.classes, 10.0 ** scorer.inside[context].astype(float), minlength=attention_lm.CLASSES)
        filled = np.bincount(scorer.classes, minlength=attention_lm.CLASSES) > 0
        assert np.allclose(mass[filled], 1, atol=1e-4)


def test_language_model_base_and_cases(spark, codec_args, quick_model, monkeypatch):
    monkeypatch.setattr(attention_lm, "HEAVY", 20)  # most words take the way of the join
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(70, None), (71, ""), (None, "W1\x0bw2 x"), (72, "new " * 3000), (72, "new " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1))
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    got = attention_lm.score_texts(docs, training, *codec_args, epochs=1).collect()
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [""]
    c = Counter(w for i, t in rows if i is None or i % 3 for w in cut(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(cut(t)), sum(c[w] > 0 for w in cut(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in cut(t)), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    none = attention_lm.score_texts(docs.where("false"), training, *codec_args, epochs=1)
    assert none.collect() == []
    untaught = attention_lm.score_texts(docs.limit(3), F.lit(False), *codec_args, epochs=1).collect()
    assert [r.n_known for r in untaught] == [0, 0, 0] and all(r.held_out and r.train_tokens == 0 for r in untaught)


def test_language_model_learns(spark):
    p = queries.queries()["op1_attention_lm"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    held = p[p.held_out]
    assert len(p) == docs and (p.held_out == p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 7 == 2)).all()
    # well below what a uniform guess over the vocabulary would cost, on texts that it has not seen
    assert held.score.sum() / held.n_tokens.sum() > -4.6


def test_language_model_trains_on_all_windows(spark, codec_args, monkeypatch):
    """Every window of every text counts, in several tasks, and subwords outside the sample get embeddings of their own."""
    monkeypatch.setattr(attention_lm, "SAMPLE_WINDOWS", 5)
    monkeypatch.setattr(attention_lm, "SHARE_CHARS", 2_000)
    sub, seen = attention_lm.Subwords(*codec_args), []
    whole = attention_lm.train_all
    monkeypatch.setattr(attention_lm, "train_all", lambda *a: seen.append(whole(*a)))
    rows = [(i, " ".join(f"word{(i * k) % 89} the" for k in range(i % 50))) for i in range(120)]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    scorer, _ = attention_lm.train(texts, attention_lm.count_words(texts), *codec_args, epochs=1)
    assert seen == [sum(len(attention_lm.windows_of(attention_lm.ids_of(t.encode(), sub))) for _, t in rows)]
    used = sorted({i for _, t in rows for w in t.encode().split() for i in sub.of(w)})
    assert len(set(scorer.row[used])) == len(used) == len({scorer.table[scorer.row[i]].tobytes() for i in used})


def test_digests(spark, codec_args):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = bpe.codec(*codec_args).encoding
    for r in queries.queries()["op2_byte_bpe"](spark, sf).collect():
        ids = whole.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = {r.doc_id: r for r in queries.queries()["op3_decontamination"](spark, sf).collect()}
    for i in list(texts)[:60] + [i for i, r in found.items() if r.n_hit][:20]:
        n, hit, owners = slow_hits(texts[i][:20000] if not found[i].n_hit else texts[i], items) if len(texts[i]) < 20000 else (None,) * 3
        if n is not None:
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items) == (n, len(hit), len(owners))
            assert r.items_sha256 == hashlib.sha256(",".join(owners).encode()).hexdigest() and r.contaminated == (bool(hit) and 20 * len(hit) >= n)
