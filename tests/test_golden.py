"""Documented examples and traps, row by row."""

import codecs
import random
import time

import pytest
from pyspark.sql import functions as F

from loomtext import fixed
from loomtext.functions import text as T
from loomtext.functions import titles as N
from loomtext.functions.numbers import numbers_to_words
from loomtext.operators import segment as S
from loomtext.operators import sentences as Y
from loomtext.operators import telemetry as M
from loomtext.sources.files import audit_encoding


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).first()[0]


def many(spark, cases, fn):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, x string").select("i", fn(F.col("x")).alias("y")).collect()
    got = {r.i: r.y for r in rows}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_characters(spark):
    many(
        spark,
        [
            ("50%", "50-percent"),
            ("“a” ‘b’…", "\"a\" 'b'..."),
            ("a—b–c d­e​f‌g‍h", "a;b-c defgh"),
            ("5′ 6″ 0 → 10", "5 feet 6 inches 0  to  10"),
        ],
        T.replace_characters,
    )
    many(spark, [("Accept | Decline", "Accept, Decline")], lambda c: T.tighten_commas(T.replace_characters(c)))


def test_acronyms(spark):
    many(
        spark,
        [
            ("gained exp today", "gained E-X-P today"),
            ("EXP, 5 mp/s and HPS", "E-X-P, 5 M-P-S and H-P-S"),
            ("expert expé", "expert expé"),
            ("<<SPEAKER=system>>exp gained<</SPEAKER>>", "<<SPEAKER=system>>exp gained<</SPEAKER>>"),
            ("<<SPEAKER=exp>> exp <</SPEAKER>>exp", "<<SPEAKER=exp>> E-X-P <</SPEAKER>>exp"),
        ],
        T.expand_acronyms,
    )
    many(spark, [("<<SPEAKER=system>>exp gained<</SPEAKER>>", "<<SPEAKER=system>>E-X-P gained<</SPEAKER>>")], lambda c: T.expand_acronyms(c, True))


def test_brackets_ratios_signs(spark):
    many(spark, [("[Level Up]", "Level Up"), ("[a\nb]", "[a\nb]")], T.unwrap_brackets)
    many(spark, [("100/100", "100 out of 100"), ("3/15/2024", "3 out of 15 out of 2024"), ("7 / 9", "7 out of 9")], T.speak_ratios)
    many(spark, [("3/15/2024", "3/15/2024"), ("at 7/9.", "at 7 out of 9.")], lambda c: T.speak_ratios(c, True))
    many(spark, [("a +5 b -7 well-3", "a plus 5 b minus 7 well-3"), ("é+5", "é+5"), ("-1+2", "minus 1+2")], T.speak_signs)


def test_numbers(spark):
    many(
        spark,
        [
            ("99", "99"),
            ("100", "one hundred"),
            ("414,087", "four hundred and fourteen thousand and eighty-seven"),
            ("a 1,234,567 b", "a one million, two hundred and thirty-four thousand, five hundred and sixty-seven b"),
            ("1000000 and 1001000", "one million and one million, one thousand"),
            ("1000100", "one million, one hundred"),
            ("000099 0101", "000099 one hundred and one"),
            ("1234,567", "one thousand, two hundred and thirty-four,five hundred and sixty-seven"),
            ("9" * 307, "9" * 307),
            ("2" + "0" * 36, "two undecillion"),
        ],
        numbers_to_words,
    )


def test_words_of_a_series(spark):
    words = F.create_map(F.lit("DR"), F.lit("Damage Reduction"), F.lit("a+b"), F.lit("$1 \\x"))
    many(spark, [("DR dr DRY (DR)", "Damage Reduction dr DRY (Damage Reduction)"), ("see a+b now", "see $1 \\x now")], lambda c: T.replace_words(c, words))
    many(spark, [("DR", "DR")], lambda c: T.replace_words(c, F.lit(None).cast("map<string,string>")))


def test_merge_blocks(spark):
    b = lambda s, t: f"<<SPEAKER={s}>>{t}<</SPEAKER>>"
    many(
        spark,
        [
            (b("system", "A") + "\n" + b("system", " B "), b("system", "A\nB")),
            (b("system", "A") + "\n" + b("fable", "B"), b("system", "A") + "\n" + b("fable", "B")),
            ("x " + b("s", "A") + " y " + b("s", "B") + " \n", "x " + b("s", "A") + " y " + b("s", "B") + " \n"),
            (b("s", "A") + b("s", "B") + "\n\n" + b("s", "C"), b("s", "A\nB\nC")),
            ("no tags", "no tags"),
            (b("s", "<b> line\nline"), b("s", "<b> line\nline")),
        ],
        T.merge_speaker_blocks,
    )


def test_parts_and_empty_blocks(spark):
    text = "one <<SPEAKER=A>>two<</SPEAKER>>\n <<SPEAKER=B>><</SPEAKER>>three"
    parts = one(spark, text, T.parts_of)
    assert [(p.part_pos, p.speaker, p.content) for p in parts] == [(0, None, "one "), (1, "A", "two"), (2, None, "three")]
    raw = one(spark, text, lambda c: T.parts_of(c, True))
    assert [(p.speaker, p.content) for p in raw][2] == (None, "<<SPEAKER=B>><</SPEAKER>>")


@pytest.mark.parametrize(
    "title,series,want",
    [
        ("Chapter 1 - Series Name | Royal Road", "Series Name", "Chapter 1"),
        ("Series Name Chapter 1 - Series Name | Royal Road", "Series Name", "Chapter 1"),
        ("Chapter 1 - (Book 3) Series Name [genre tags] Royal Road", "Series Name", "Chapter 1"),
        ("Chapter 2 - Re:Birth", "ReBirth", "Chapter 2"),
        ("Re:Birth: Chapter 2", "ReBirth", ": Chapter 2"),
        ("Chapter 1 - Roll For Survival - Some Tale", "Some Tale", "Chapter 1 - Roll For Survival"),
        ("Some Tale", "Some Tale", "Some Tale"),
        ("B1 Chapter 3 - Series Name", "Series Name", "B1 Chapter 3"),
        ("Other", "Series", "Other"),
    ],
)
def test_strip_series(spark, title, series, want):
    df = spark.createDataFrame([(title, series)], "t string, s string")
    assert df.select(N.strip_series("t", "s")).first()[0] == want


def test_urls_and_names(spark):
    many(spark, [("u/", "u"), ("u?x=1", "u"), ("u/?x", "u/"), ("u//", "u")], N.normal_url)
    many(spark, [("2024-01-01T23:30:00-05:00", "2024-01-01"), ("2024-05-06T01:00:00Z", "2024-05-06"), (None, "unknown_date")], N.publication_date)
    many(spark, [("local", "local"), (" LOCAL ", "local"), ("https://WWW.RoyalRoad.com/f/1", "royalroad"), ("https://x.org/royalroad.com", None), ("royalroad.com/x", None)], N.source_name)
    assert one(spark, "2025-01-27_B1 Chapter_3", N.decode_file_name) == ("2025-01-27", "B1 Chapter_3")
    assert one(spark, "plain", N.decode_file_name) == (None, "plain")
    many(spark, [('a\\b/c:d*e?"<>|f', "d_abcdef.txt")], lambda c: N.encode_file_name(F.lit("d"), c))
    many(spark, [("/chapter/2309548/x", "2309548"), ("/chapters", None)], lambda c: N.index_from_url(c).cast("string"))
    many(spark, [("Ähm: “Größe”", "Ähm 'Groosse'"), ("e ́", "e'")], N.plain_title)


def test_natural_order(spark):
    names = ["Chapter 10", "chapter 2", "Chapter 02b", "10", "9", "", "Chapter", "chapter " + "1" * 50]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [r.t for r in df.orderBy(N.natural_key("t")).collect()]
    assert got == ["", "9", "10", "Chapter", "chapter 2", "Chapter 02b", "Chapter 10", "chapter " + "1" * 50]
    df = spark.createDataFrame([("Épée 10",), ("epee 9",), ("Zed",)], "t string")
    assert [r.t for r in df.orderBy(N.collated_key("t")).collect()] == ["epee 9", "Épée 10", "Zed"]


def test_durations(spark):
    got = [tuple(r) for r in spark.createDataFrame([(10,), (100,), (300,)], "n int").select(S.max_seconds(F.col("n")), S.work_estimate(F.col("n"))).collect()]
    assert got == [(15.0, 720), (30.0, 720), (90.0, 1080)]


def test_log_kinds(spark):
    cases = [
        ("[queue] queued: The Failed Experiment", "queue"),
        ("[queue] failed: X", "error"),
        ("\tThe Failed Experiment", "chapter"),
        ("[3/62] Scraping X", "series"),
        ("[sync] X: reset", "sync"),
        ("\t[t] gen", "timing"),
        ("\tSaved!", "step"),
        ("Regenerating: X", "chapter"),
        ("\tChunk too long (3s)", "warn"),
        ("\tError 404", "chapter"),
        ("\tError on TTS: x", "error"),
        ("x disk I/O ERROR y", "error"),
        ("hello", "info"),
    ]
    many(spark, cases, lambda c: M.parse_line(c)["kind"])
    item = one(spark, "[3/62] Generating The Tale ", M.parse_line)
    assert (item.phase, item.idx, item.total, item.text) == ("generate", 3, 62, "The Tale")


def test_split_log(spark):
    df = spark.createDataFrame([(1, "\x1b[32mok\x1b[0m\rtwo\n\n three")], "seq int, line string")
    assert [r.line for r in M.split_log(df).collect()] == ["ok", "two", "three"]
    assert [r.line for r in M.split_log(df, keep_indent=True).collect()] == ["ok", "two", " three"]


def test_paragraph_rules(spark):
    msgs = F.array(F.lit("Stolen text."), F.lit("Read it here!"))
    lines = ["Stolen text.", " A  b .", "A b.", "A b. Stolen text.", "Read it here!Stolen text. x", "x", "", "Read it here! Stolen text."]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    got = [(p.pos, p.line) for p in df.select(T.clean_paragraphs(F.col("l"), msgs)).first()[0]]
    # a line with a message cut out stays although its rest was seen; the later plain 'x' goes
    assert got == [(1, "A b."), (3, "A b."), (4, "x")]
    second = [p.line for p in df.select(T.clean_paragraphs(F.col("l"), msgs, False, False)).first()[0]]
    assert second == ["A  b .", "A b.", "A b.", "x", "x"]


def test_full_cleaning(spark):
    text = "“Hi” — <<SPEAKER=system>>HP 1,200/1,500 | +5<</SPEAKER>>\n<<SPEAKER=system>>[New exp skill]<</SPEAKER>>"
    assert one(spark, text, T.clean_for_speech) == (
        '"Hi" ; <<SPEAKER=system>>HP one thousand, two hundred out of one thousand, five hundred, plus 5\nNew E-X-P skill<</SPEAKER>>'
    )


def test_status_values_are_plain():
    assert fixed.STATUSES == ["pending", "processing", "done", "failed"]


def test_long_and_foreign_numbers(spark):
    from loomtext.functions.numbers import MAX_DIGITS, unspoken_numbers

    arabic = "".join(chr(0x660 + int(d)) for d in "1234")
    rows = [("1" + "0" * 66, "one unvigintillion"), ("5" + "0" * 303, "five centillion"), (f"a {arabic} b", "a one thousand, two hundred and thirty-four b"), ("9" * 307, "9" * 307)]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(numbers_to_words("t").alias("w"), unspoken_numbers("t").alias("u")).collect()
    assert [r.w for r in got] == [w for _, w in rows]
    assert MAX_DIGITS == 306 and [len(r.u) for r in got] == [0, 0, 0, 1]


def test_calls_fold_and_edits_take_the_last(spark):
    from loomtext.operators import compare as C
    from loomtext.operators import state as ST

    now = F.expr("timestamp '2024-03-02'")
    old = spark.createDataFrame([(7, "A", "u", None, None, None)], "id long, name string, url string, source string, narrator string, latest_url string")
    for c in ("last_scraped_at", "created_at", "updated_at"):
        old = old.withColumn(c, F.expr("timestamp '2024-01-01'"))
    calls = [(1, "A", "v", None, "n"), (2, "A", None, "s", None), (3, "B", "x", None, None), (4, "B", None, None, "m"), (5, None, "q", None, None), (6, "C", None, None, None)]
    new = spark.createDataFrame([(*c, None) for c in calls], "seq int, name string, url string, source string, narrator string, latest_url string")
    got = sorted((r.id, r.name, r.url, r.source, r.narrator) for r in ST.upsert_series(old, new, now).collect())
    assert got == [(7, "A", "v", "s", "n"), (8, "B", "x", None, "m"), (9, "C", None, None, None)]
    texts = spark.createDataFrame([(1, "old"), (2, "kept")], "id int, text string")
    edits = spark.createDataFrame([(1, "first", 1), (1, "second", 2)], "id int, new_text string, seq int")
    assert sorted(tuple(r) for r in C.apply_texts(texts, edits).collect()) == [(1, "second", True), (2, "kept", False)]


def test_a_second_reconcile_registers_nothing(spark):
    """Rows registered by the first run, whose ids are still open, are known to the second; a failed one stays failed."""
    from loomtext.operators import state as ST

    now = F.expr("timestamp '2024-03-02'")
    files = spark.createDataFrame([(1, "/a/2024_x.txt")], "series_id long, raw_path string")
    none = spark.createDataFrame([], "series_id long, path string")
    series = spark.createDataFrame([(1,)], "id long")
    kinds = "id long, series_id long, title string, published_date string, raw_path string, status string, output_path string, updated_at timestamp"
    first = ST.surviving(ST.reconcile(spark.createDataFrame([], kinds), files, none, series, now))
    failed = first.withColumn("status", F.lit("failed"))
    again = ST.reconcile(failed, files, none, series, now).collect()
    assert [(r.status, r.actions) for r in again] == [("failed", [])]


def test_log_spaces_and_queued_jobs(spark):
    from loomtext.operators import telemetry as M

    lines = spark.createDataFrame([("[1/2] Scraping X",), ("[queue] later",)], "line string").select(M.parse_line(F.col("line")).alias("p"))
    assert [(r.p.kind, r.p.text) for r in lines.collect()] == [("series", "X"), ("queue", "later")]
    events = spark.createDataFrame([(1, "j", "chunk_progress", None), (2, "k", "job_started", None)], "seq int, job_id string, type string, error string").withColumn("ts", F.expr("timestamp '2024-01-01'"))
    assert {r.job_id: r.status for r in M.lifecycle(events).collect()} == {"j": "queued", "k": "running"}


def test_sentences_by_learnt_words(spark):
    model = Y.SentenceModel(("dr", "e.g", "mr", "p.m", "st"), ("he", "the"))
    many(
        spark,
        [
            (
                "Dr. Ash met Mr. Elm, e.g. at St. Ives. The J. R. Oak tree fell... and lay there. He left.",
                ["Dr. Ash met Mr. Elm, e.g. at St. Ives.", "The J. R. Oak tree fell... and lay there.", "He left."],
            ),
            ('She said "Stop!" He went (to Mr. Elm). They saw.', ['She said "Stop!"', "He went (to Mr. Elm).", "They saw."]),
            ("It rang at 5 p.m. He slept.", ["It rang at 5 p.m.", "He slept."]),
            ("It rang at 5 p.m. Elm slept.", ["It rang at 5 p.m. Elm slept."]),
            ("It cost 3. then 4. Five came.\nLate... The end", ["It cost 3. then 4.", "Five came.", "Late...", "The end"]),
            ("", []),
            (" \n ", []),
            (None, None),
        ],
        lambda c: Y.split_sentences(c, model),
    )


def test_words_learnt_from_texts(spark):
    text = "Dr. Ash met Mr. Elm here. He saw a cat. The cat ran home. He was here at noon. The noon home was dark. He met a dark cat."
    rows = spark.createDataFrame([(text,)] * 100 + [(None,), ("",)], "text string")
    assert Y.learn_sentences(rows) == Y.SentenceModel(("dr", "mr"), ("he", "the"))
    assert Y.learn_sentences(spark.createDataFrame([("no stop here",), (None,)], "text string")) == Y.SentenceModel((), ())
    assert Y.learn_sentences(rows.limit(0)) == Y.SentenceModel((), ())


def test_learning_takes_long_rows_of_marks(spark):
    dots = "." * 200_000
    texts = spark.createDataFrame([(f"He met Dr. Ash {dots}x and left. She came ?!) then",)], "text string")
    types = Y.count_types(texts)
    at = time.perf_counter()
    found = Y.starter_scores(texts, types, ["dr"]).select("type", "n", "after").collect()
    # a search from every mark to the end of the row takes a minute
    assert time.perf_counter() - at < 15
    assert sorted(map(tuple, found)) == [("she", 1, 1), ("then", 1, 1)]


def test_undecodable_bytes(spark):
    """Python's decoder names the same bytes, over blocks as well."""
    rng = random.Random(5)
    seen = []
    codecs.register_error("note", lambda e: (seen.extend(range(e.start, e.end)), ("", e.end))[1])
    good = ["a", "é", "\u0800", "\uffff", "\ufffd", "\U00010000", "\U0010ffff"]
    pieces = [*(g.encode() for g in good), b"\xff", b"\xc0\xaf", b"\xed\xa0\x80", b"\xe2\x82", b"\xf0\x9f\x98", b"\x80", b"\xf4\x90\x80\x80", b"\xe0\x9f\xbf"]
    cases = [b"", b"plain", "\ufffd".encode(), b"x" * 65535 + "é".encode() + b"\xff" + b"x" * 65534 + b"\xc3"]
    cases += [b"".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(200)]
    rows = [(i, bytearray(c)) for i, c in enumerate(cases)] + [(-1, None)]
    found = audit_encoding(spark.createDataFrame(rows, "i int, content binary"))
    got = {r.i: r for r in found.collect()}
    assert got[-1].undecodable is None
    for i, data in enumerate(cases):
        seen.clear()
        data.decode("utf-8", "note")
        assert [(u.offset, u.byte) for u in got[i].undecodable] == [(at, data[at]) for at in seen], data
        assert got[i].invalid == bool(seen) and got[i].bad_bytes == len(seen)
