"""Properties and brute-force comparisons on small fixtures, with the scale limits turned down."""

import difflib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtext import fixed
from loomtext.functions import text as T
from loomtext.operators import boilerplate as B
from loomtext.operators import compare as C
from loomtext.operators import ranking as R
from loomtext.operators import segment as S
from loomtext.operators import state as ST
from loomtext.operators import telemetry as M
from loomtext.operators.chains import follow_links
from loomtext.plans.fixtures import Fixtures
from loomtext.schemas import CHAPTERS
from loomtext.session import collect_bounded, cut_lineage, work_path
from loomtext.sources.tables import read_state, valid_status

SF = "/root/testdata/sf0.001"


def test_cleaning_steps_are_idempotent(spark):
    docs = Fixtures(spark, SF).documents
    for fn in (T.replace_characters, T.tighten_commas, T.unwrap_brackets):
        # the percent sign is spoken once and then gone
        assert docs.where(fn(fn("text")) != fn("text")).count() == 0


def test_parts_join_to_the_text(spark):
    tagged = Fixtures(spark, SF).V_tagged
    joined = F.aggregate(
        T.parts_of("text"), F.lit(""),
        lambda a, p: F.concat(a, F.when(p["tagged"], F.concat(F.lit("<<SPEAKER="), p["speaker"], F.lit(">>"), p["content"], F.lit("<</SPEAKER>>"))).otherwise(p["content"])),
    )
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    assert tagged.where(bare(joined) != bare(F.col("text"))).count() == 0


def py_pack(text, limit):
    chunks, buf = [], ""
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", text))):
        if len(s) > limit:
            chunks += [buf.strip()] if buf else []
            buf, words = "", ""
            for w in s.split():
                if len(words) + len(w) + 1 > limit:
                    chunks.append(words.strip())
                    words = ""
                words += w + " "
            chunks += [words.strip()] if words else []
        elif buf and len(buf) + 2 + len(s) > limit:
            chunks.append(buf)
            buf = s
        else:
            buf = f"{buf}\n\n{s}" if buf else s
    return chunks + ([buf] if buf else [])


def test_packing_equals_a_plain_loop(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(150):
        words = ["x" * rng.choice([1, 3, 7, 30, 60]) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randint(0, 900))]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for limit in (25, 50, 750):
        got = {r.i: r.c for r in df.select("i", S.pack("t", limit).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == py_pack(t, limit)


def test_chunks_keep_the_limit(spark):
    docs = Fixtures(spark, SF).documents
    chunks = docs.select(F.explode(S.pack("text", 250)).alias("c"))
    assert chunks.where((F.length("c") > 250) & F.col("c").contains(" ")).count() == 0


def test_number_by_buckets_equals_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    want = {r.i: r.rn for r in df.select("i", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), "i")).alias("rn")).collect()}
    for hot in (1, 1000, 10**9):
        got = R.row_number_by(df, ["k"], [F.desc("v"), F.asc("i")], [-F.col("v"), F.expr("i div 50")], "rn", hot)
        assert {r.i: r.rn for r in got.collect()} == want
    whole = R.row_number_by(df, [], [F.asc("i")], [F.expr("i div 7")])
    assert all(r.rn == r.i + 1 for r in whole.collect())


def test_pages_cover_the_table(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(53)], "i int, v int")
    for shallow in (0, 30, 10_000):  # all in buckets, both ways, all as a top-k
        page = lambda k: [r.i for r in R.page(df, [F.asc("v"), F.asc("i")], [F.col("v"), F.expr("i div 10")], k, 10, shallow).collect()]  # noqa: B023,E731
        seen = [x for k in range(6) for x in page(k)]
        assert seen == sorted(range(53), key=lambda i: (i % 7, i))
        assert page(99) == page(5)


def test_page_of_an_empty_table(spark):
    df = spark.createDataFrame([], "i int")
    assert R.page(df, [F.asc("i")], [F.col("i")], 3, 10).count() == 0


def test_next_after_equals_scan(spark):
    rng = random.Random(5)
    targets = [(rng.choice("ab"), rng.randint(0, 500), i) for i in range(60)]
    probes = [(rng.choice("abc"), rng.randint(-20, 520), rng.choice([-1, 30]), i) for i in range(200)]
    t = spark.createDataFrame([(k, a, i, i) for k, a, i in targets], "k string, at int, tie int, id int")
    p = spark.createDataFrame(probes, "k string, at int, tie int, pid int")
    got = {r.pid: r.id for r in R.next_after(p, t, ["k"], "at", "tie", "id", 7).collect()}
    for k, a, tie, pid in probes:
        later = sorted((x, i) for kk, x, i in targets if kk == k and (x, i) > (a, tie))
        assert got[pid] == (later[0][1] if later else None)


def test_follow_links_stops_at_ends_and_loops(spark):
    links = [("a", str(i), str(i + 1)) for i in range(37)] + [("b", str(i), str((i + 1) % 5 + 2 if i == 6 else i + 1)) for i in range(7)] + [("c", "x", "x")]
    df = spark.createDataFrame(links, "s string, url string, next_url string")
    starts = spark.createDataFrame([("a", "3"), ("b", "0"), ("c", "x"), ("d", "q")], "s string, url string")
    got = {}
    for r in follow_links(df, starts, ["s"]).orderBy("s", "hop").collect():
        got.setdefault(r.s, []).append((r.hop, r.url))
    nxt = {(s, u): v for s, u, v in links}
    for s, u in [("a", "3"), ("b", "0"), ("c", "x"), ("d", "q")]:
        seen, at = [], u
        while at is not None and at not in seen:
            seen.append(at)
            at = nxt.get((s, at))
        assert got[s] == list(enumerate(seen))


@pytest.mark.parametrize("hot", [0, 300])
def test_contracted_chains_equal_a_walk(spark, hot):
    """Long chains, circles, and nodes that several links lead to: contracted, or only those of large keys."""
    rng = random.Random(hot)
    nxt = {}
    for key, n, back in (("long", 2000, None), ("circle", 700, 300), ("tree", 800, None), ("short", 5, None), (None, 6, None)):
        for i in range(n):
            to = rng.randint(i + 1, min(i + 4, n)) if key == "tree" else i + 1
            nxt[key, i] = back if back is not None and i == n - 1 else to
    df = spark.createDataFrame([(k, i, to) for (k, i), to in nxt.items() if k is not None], "s string, url bigint, next_url bigint")
    begin = [("long", 0), ("circle", 5), ("tree", 0), ("tree", 1), ("short", 3)]
    got = {(r.s, r.url): r.hop for r in follow_links(df, spark.createDataFrame(begin, "s string, url bigint"), ["s"], hot_links=hot).collect()}
    want = {}
    for key, at in begin:
        hop = 0
        while at is not None and want.get((key, at), hop + 1) > hop:
            want[key, at] = hop
            at, hop = nxt.get((key, at)), hop + 1
    assert got == want


def test_contraction_writes_in_proportion_to_the_links(spark, tmp_path, monkeypatch):
    """Rows written for one key of 4,000 and of 16,000 links: four times as many, not four times and two rounds more of each."""
    from loomtext.operators import chains

    written = {}
    for n in (4_000, 16_000):
        total = []

        def cut(df):
            out = cut_lineage(df)
            total.append(out.count())
            return out

        monkeypatch.setattr(chains, "cut_lineage", cut)
        links = spark.range(n).select(F.lit("k").alias("s"), F.col("id").alias("url"), (F.col("id") + 1).alias("next_url"))
        got = chains.follow_links(links, spark.createDataFrame([("k", 0)], "s string, url bigint"), ["s"], hot_links=10)
        assert got.count() == n + 1 and got.where("hop != url").isEmpty()
        written[n] = sum(total)
    # contraction: a sum of falling tables; putting back: of rising ones; the short rest is a sixteenth
    assert written[16_000] < 4.6 * written[4_000]
    assert written[16_000] < 16 * 16_000


def test_ranges_share_the_rows(spark):
    """50 keys of which one has a third of the rows: no range holds above twice the median."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("at"), F.col("id").alias("tie"))
    probes, targets = rows.withColumn("pid", F.col("tie")), rows.withColumn("t", F.col("tie"))
    seen = R.next_after(probes, targets, ["k"], "at", "tie", "t", 24)
    sizes = sorted(r.n for r in seen.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect())
    assert len(sizes) >= 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    want = rows.selectExpr("k", "at", "lead(tie) over (partition by k order by at) as t")
    assert seen.select("k", "at", "t").exceptAll(want.select("k", "at", "t")).isEmpty()


def test_requests_equal_a_plain_loop(spark):
    rng = random.Random(11)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 0, 60, 600, 4000])
        rows.append((i, rng.choice("aab"), t, t + rng.choice([0, 0, 30, 900, 20000])))
    df = spark.createDataFrame(rows, "id long, key string, c long, f long")
    df = df.select("id", "key", F.timestamp_seconds("c").alias("created"), F.timestamp_seconds("f").alias("finished"))
    want, busy = set(), {}
    for i, k, c, f in rows:
        if c >= busy.get(k, -1):
            want.add(i)
            busy[k] = f
    for parts in (None, 1, 40):
        assert {r.id for r in M.accepted_requests(df, parts).collect()} == want


def test_log_marks_equal_a_plain_loop(spark):
    rng = random.Random(2)
    kinds = ["chapter", "step", "step", "series", "timing", "info", "queue", "warn"]
    rows = [(i + 1, i, k, "Converted to MP3!" if k == "step" and rng.random() < 0.5 else "x") for i, k in enumerate(rng.choice(kinds + ["warn"] * n) for n in [rng.choice([0, 60])] for _ in range(1500))]
    ok, empty = set(), set()
    for i, (_, _, k, text) in enumerate(rows):
        if k == "step" and text.startswith("Converted"):
            for j in range(i - 1, max(i - 31, -1), -1):
                if rows[j][2] == "chapter":
                    ok.add(j + 1)
                if rows[j][2] in ("chapter", "series"):
                    break
        if k in ("series", "queue", "sync"):
            for j in range(i - 1, -1, -1):
                if rows[j][2] == "series":
                    empty.add(j + 1)
                if rows[j][2] not in ("timing", "info"):
                    break
    df = spark.createDataFrame(rows, "pos long, seq long, kind string, text string")
    for block in (31, 100, 65536):
        assert {r.pos for r in M.mark_finished(df, block).collect()} == ok
        assert {r.pos for r in M.mark_empty(df, block).collect()} == empty


def test_cuts_are_those_of_the_whole_list(spark):
    """Messages inside others, joined by cuts, of few words and many, with odd spaces: row by row the fold over the whole list."""
    rng = random.Random(17)
    words = ["a", "bb", "c,", "SPAM", "d", "report", "it."]
    messages = list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 8]))) for _ in range(60)))
    texts = []
    for _ in range(150):
        lines = []
        for _ in range(rng.randint(0, 5)):
            m, n = rng.choice(messages), rng.choice(messages)
            at = rng.randrange(len(m) + 1)
            lines.append(rng.choice(["", "x ", " x  "]) + rng.choice([m, m[:at] + n + m[at:], " ".join(rng.choice(words) for _ in range(9))]) + rng.choice(["", "\ty", "  "]))
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = spark.createDataFrame(list(enumerate(messages)), "item_id long, message string")
    for spaces in (True, False):
        lines = B.normal_lines(F.split("text", "\n", -1), spaces)
        cut_all = lambda held, spaces=spaces, lines=lines: F.transform(lines, lambda x: T.cut_messages(x, held, spaces))
        whole = cut_all(T.constant_list(messages))
        want = {r.doc_id: r.l for r in docs.select("doc_id", whole.alias("l")).collect()}
        for most in (2_000, 0):
            held = B.attach_messages(docs, listed, lines=lines, collapse_spaces=spaces, max_rows=most)
            got = held.select("doc_id", cut_all(F.col("messages")).alias("l"))
            assert {r.doc_id: r.l for r in got.collect()} == want


@pytest.mark.parametrize("few", [200, 0])
def test_long_message_lists_give_the_same_matches(spark, few, monkeypatch):
    monkeypatch.setattr(B, "FEW_SHORT", few)
    fx = Fixtures(spark, SF)
    extra = [(10**9 + i, m) for i, m in enumerate(["the", "and th", "  ", "e", " of the ", "zzz none", "."])]
    msgs = fx.V_block.unionByName(spark.createDataFrame(extra, "item_id long, message string"))
    odd = spark.createDataFrame([(-1, "x zzz the  none y"), (-2, "a ofthe  the b"), (-3, None)], "doc_id long, text string")
    docs = fx.documents.select("doc_id", "text").unionByName(odd)
    cut = F.array_join(F.transform(B.clean_paragraphs(F.split("text", "\n", -1), F.col("messages")), lambda p: p["line"]), "\n")
    lines = F.split("text", "\n", -1)
    lines = B.normal_lines(lines)
    short = B.attach_messages(docs, msgs, lines=lines, collapse_spaces=True)
    long = B.attach_messages(docs, msgs, lines=lines, collapse_spaces=True, max_rows=0)
    want = {r.doc_id: r.cut for r in short.select("doc_id", cut.alias("cut")).collect()}
    assert want == {r.doc_id: r.cut for r in long.select("doc_id", cut.alias("cut")).collect()}
    assert long.select(F.sum(F.size("messages"))).first()[0] > 400


def test_pages_lose_messages_and_series_names(spark):
    html = '<title>Chapter 1 - My Tale | Royal Road</title><time datetime="2024-05-06T07:08:09Z"></time><div class="chapter-content"><p>Text <b>one</b> , here.</p><p>Stolen  from its author , report it.</p><p>Text one, here.</p><p>Keep SPAMthis</p></div>'
    rows = [(1, "https://h/1", html, "My Tale", 200), (2, "https://h/2", html, None, 404), (3, "https://h/3", "<p>no</p>", "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, series string, status int")
    list_of = spark.createDataFrame([(1, "SPAM"), (2, "Stolen from its author, report it.")], "item_id long, message string")
    for most in (2000, 0):
        got = {r.page_id: r for r in B.clean_pages(pages, list_of, series="series", status="status", max_rows=most).collect()}
        assert (got[1].title, got[1].published_date, got[1].text) == ("Chapter 1", "2024-05-06", "Text one, here.\nKeep this")
        assert [got[i].unavailable for i in (1, 2, 3)] == [False, True, False] and got[3].text == "Content not found"


def test_size_check_refuses_large_lists(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("m"))
    assert len(collect_bounded(df, "m", 50)) == 50
    assert collect_bounded(df, "m", 49) is None
    assert collect_bounded(df, "m", 50, 10) is None


def test_reconcile_settles(spark):
    """A reverted row whose other output exists is marked by the next run; after that nothing moves."""
    fx = Fixtures(spark, SF)
    now = F.expr("timestamp '2024-03-02'")
    state, acted = fx.V_chapters, []
    for _ in range(3):
        run = ST.reconcile(state, fx.V_files, fx.V_outputs, fx.V_series, now)
        acted.append({r.raw_path: r.actions for r in run.where(F.size("actions") > 0).collect()})
        state = ST.surviving(run).withColumn("id", F.coalesce("id", F.xxhash64("raw_path")))
    assert acted[0] and acted[2] == {}
    assert all(a == ["marked"] and "reverted" in acted[0][p] for p, a in acted[1].items())


def test_reconcile_skips_unknown_series(spark):
    none = spark.createDataFrame([], "series_id long, path string")
    series = spark.createDataFrame([(1,)], "id long")
    chapters = Fixtures(spark, SF).V_chapters.limit(0)
    files = spark.createDataFrame([(1, "/a/2024_x.txt"), (9, "/b/y.txt"), (1, "/a/x_cleaned.txt"), (1, "/a/x.md")], "series_id long, raw_path string")
    rows = ST.reconcile(chapters, files, none, series, F.expr("timestamp '2024-03-02'")).collect()
    assert [(r.title, r.published_date, r.status, r.actions) for r in rows] == [("x", "2024", "pending", ["registered"])]
    stored = Fixtures(spark, SF).V_chapters
    kept = ST.reconcile(stored, files.limit(0), none, series.where("id < 0"), F.expr("timestamp '2024-03-02'"))
    assert kept.where(F.size("actions") > 0).count() == 0 and kept.count() == stored.count()


def test_batches_keep_the_size(spark):
    rows = S.length_batches(Fixtures(spark, SF).V_chunks, ["doc_id", "speaker"], 4)
    assert rows.groupBy("doc_id", "speaker", "batch").count().where("count > 4").count() == 0


def test_work_list_orders(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 2309548, "b"), (3, 5, "c")], "id int, chapter_index long, raw_path string")
    df = df.withColumns({"status": F.lit("pending"), "published_date": F.lit("d")})
    assert [r.id for r in ST.work_list(df).collect()] == [3, 1, 2]
    assert [r.id for r in ST.work_list(df, nulls_last=True).collect()] == [3, 2, 1]


line = st.lists(st.sampled_from(["a", "b", "c", "++d", ""]), max_size=12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(line, line), min_size=1, max_size=30))
def test_diff_counts(spark, pairs):
    texts = [("\n".join(a) + "\n", "\n".join(b) + "\n") for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, old_text string, new_text string")
    got = {r.id: r for r in C.line_diff(df).collect()}
    low = {r.id: r for r in C.line_counts(df).collect()}
    for i, (a, b) in enumerate(texts):
        a, b = a.splitlines(), b.splitlines()
        r = got[i]
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        assert (r.removed, r.added) == (sum(o[2] - o[1] for o in ops), sum(o[4] - o[3] for o in ops))
        assert len(b) - len(a) == r.added - r.removed
        assert low[i].added <= r.added and low[i].removed <= r.removed
        kinds = [x.kind for x in r.lines]
        assert kinds.count("add") == r.added and kinds.count("del") == r.removed
        want = list(difflib.unified_diff(a, b, "Current", "New", lineterm="")) if len(a) < 200 else None
        strip_range = lambda xs: [x for x in xs if not x.startswith("@@")]
        assert strip_range([x.text for x in r.lines]) == strip_range(want)


def test_older_snapshots_read_a_new_column_as_null(spark):
    path = work_path(spark, "state")
    Fixtures(spark, SF).V_chapters.select("id", "status").write.parquet(path)
    rows = read_state(spark, path, CHAPTERS)
    assert rows.columns == CHAPTERS.names
    assert rows.where("duration_s is null").count() == rows.count() > 0
    assert valid_status(rows, fixed.STATUSES).count() == rows.count()
