"""Boilerplate messages: which of them a document may hold, and their removal.

Messages are looked for in the text as the removal sees it: in normalised lines, and again after each cut,
since a cut can bring the ends of another message together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, explode_rows, let
from ..functions.text import clean_paragraphs, closed_messages, cut_states, normal_line, word_runs
from ..session import broadcast_if_small, collect_bounded, cut_lineage
from ..sources.pages import FIRST_SITE, Profile, extract_pages, finish_pages

_GRAM = 8
MAX_ROUNDS = 50
#: messages of one or two words up to this many are literals
FEW_SHORT = 200


def normal_lines(lines: Column, collapse_spaces: bool = True) -> Column:
    """The lines as removal compares them."""
    return F.transform(lines, lambda x: normal_line(x, collapse_spaces))


def attach_messages(
    docs: DataFrame,
    messages: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    message: str = "message",
    order: str = "item_id",
    max_rows: int = 2_000,
    max_bytes: int = 1 << 20,
    lines: Column | None = None,
    collapse_spaces: bool = False,
) -> DataFrame:
    """Add ``messages``: the messages to cut out of each document, in list order.

    With ``lines`` (an array of lines as ``normal_lines`` gives them; no message spans a line end) they are matched in the lines,
    else in the text itself. A document gets the messages that occur in it or in what earlier cuts leave. A list within the stated
    size is a literal and is met in the document's own row; a longer one is joined. Both lead to the same cuts.
    """
    messages = messages.where(F.col(message).rlike(r"\S"))
    seen = F.array(col(text)) if lines is None else lines
    small = collect_bounded(messages.orderBy(order), message, max_rows, max_bytes)
    if small is not None:
        return docs.withColumn("messages", closed_messages(small, seen, collapse_spaces))
    # read in every round
    body = cut_lineage(docs.select(doc_id, F.array_join(seen, "\n").alias("text")))
    per_doc = _closed_matches(body, messages, doc_id, message, order, collapse_spaces, lines is not None)
    return docs.join(per_doc, doc_id, "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))


def _closed_matches(body: DataFrame, messages: DataFrame, doc_id: str, message: str, order: str, collapse_spaces: bool, by_line: bool) -> DataFrame:
    """(doc_id, messages): what occurs in the texts and in every state that cutting it leaves, round after round.

    Only documents that got new messages go into the next round, as the states between their cuts.
    """
    found = cut_lineage(anchored_matches(body, messages, "text", doc_id, message, order))
    new = found
    for _ in range(MAX_ROUNDS):
        if new.isEmpty():
            break
        lists = _listed(found, doc_id, message, order).join(new.select(doc_id).distinct(), doc_id, "left_semi")
        states = F.flatten(F.transform(F.split("text", "\n", -1) if by_line else F.array("text"), lambda x: cut_states(x, F.col("messages"), collapse_spaces)))
        after = body.join(lists, doc_id).select(doc_id, F.array_join(F.array_distinct(states), "\n").alias("text"))
        more = anchored_matches(after, messages, "text", doc_id, message, order)
        new = cut_lineage(more.join(found.select(doc_id, order), [doc_id, order], "left_anti"))
        found = cut_lineage(found.unionByName(new))
    else:
        raise RuntimeError(f"cuts went on for more than {MAX_ROUNDS} rounds")
    return _listed(found, doc_id, message, order)


def _listed(found: DataFrame, doc_id: str, message: str, order: str) -> DataFrame:
    listed = F.array_sort(F.collect_set(F.struct(order, message)))
    return found.groupBy(doc_id).agg(F.transform(listed, lambda m: m[message]).alias("messages"))


def anchored_matches(
    docs: DataFrame, messages: DataFrame, text: str, doc_id: str, message: str, order: str
) -> DataFrame:
    """(doc_id, order, message) for every message a document holds.

    A text that holds a message holds the message's inner words as words in a row, so texts and messages meet on hashes of two
    words (of a message with one inner word, on that word). A message is filed under its run that the fewest documents hold, and
    only the documents that hold it are checked against the text, which comes in last. One pass hashes the texts; what it keeps,
    the runs that are in the list at all, is written once. Of messages of one or two words a few are literals. Else such a message lies
    with its longest word inside some word of the texts: it is filed under every word of the
    vocabulary that contains it, found by runs of its first characters. The array built per document afterwards is bounded by
    the document itself.
    """
    words = F.split(col(message), r"\s+")
    longest = lambda ws: F.element_at(F.array_sort(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(1)))
    # the last of the pairs is a word alone
    runs = let(inner, lambda ws: F.when(F.size(ws) == 1, F.array(F.xxhash64(ws[0]))).otherwise(F.slice(word_runs(ws, False), F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))))
    filed = cut_lineage(messages.select(order, message, F.size(words).alias("n"), runs.alias("runs"), longest(words).alias("word")))
    sizes = {r.n for r in filed.select(F.least("n", F.lit(4)).alias("n")).distinct().collect()}  # at most four values
    body = docs.select(doc_id, text)
    found = []
    if sizes & {3, 4}:
        parts = filed.where("n >= 3").select(order, message, F.explode(F.array_distinct("runs")).alias("run"))
        in_text = let(F.split(text, r"\s+"), lambda ws: F.array_distinct(word_runs(ws, 3 in sizes)))
        listed = broadcast_if_small(parts.select("run").distinct(), max_rows=1_000_000)
        held = cut_lineage(explode_rows(body, in_text, "run", doc_id).join(listed, "run", "left_semi"))
        # documents that hold each run; one that none holds rules its message out
        counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        rarest = parts.join(counts, "run", "left").groupBy(order, message)
        table = rarest.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("m")).where("m.n > 0").select("m.run", order, message)
        found.append(held.join(table, "run").select(doc_id, order, message))
    short = filed.where("n < 3")
    few = short.select(order, message).limit(FEW_SHORT + 1).collect() if sizes & {1, 2} else []
    direct = None
    if 0 < len(few) <= FEW_SHORT:
        # a few short messages are looked for in each text as they are
        listed = F.array(*[F.struct(F.lit(r[order]).alias(order), F.lit(r[message]).alias(message)) for r in few])
        direct = explode_rows(body, F.filter(listed, lambda m: F.contains(col(text), m[message])), "m", doc_id).select(doc_id, "m.*")
    elif few:
        doc_words = cut_lineage(explode_rows(body, F.array_distinct(F.split(text, r"\s+")), "word", doc_id))
        filed_short = short.select(order, message, F.col("word").alias("part"), F.substring("word", 1, _GRAM).alias("run"))
        lengths = sorted(n for (n,) in filed_short.select(F.length("run")).distinct().collect())  # at most _GRAM values
        all_runs = [F.regexp_extract_all("word", F.lit(rf"(?=(\S{{{n}}}))"), F.lit(1)) for n in lengths]
        holds = explode_rows(doc_words.select("word").distinct(), F.array_distinct(F.concat(*all_runs)), "run", "word").join(filed_short, "run")
        table = holds.where(F.contains(F.col("word"), F.col("part"))).select("word", order, message)
        found.append(doc_words.join(table, "word").select(doc_id, order, message))
    sure = [direct] if direct is not None else []
    if found:
        pairs = reduce(DataFrame.unionByName, found).distinct()
        sure.append(pairs.join(body, doc_id).where(F.contains(F.col(text), F.col(message))).select(doc_id, order, message))
    if not sure:
        return body.join(messages.select(order, message), F.lit(False)).select(doc_id, order, message)
    return reduce(DataFrame.unionByName, sure).distinct()


def clean_documents(
    docs: DataFrame, messages: DataFrame, collapse_spaces: bool = True, dedupe: bool = True, **kw
) -> DataFrame:
    """Add ``paragraphs`` (array<struct<pos, line>>) and ``clean_text``."""
    lined = docs.withColumn("__lines", normal_lines(F.split("text", "\n", -1), collapse_spaces))
    held = attach_messages(lined, messages, lines=F.col("__lines"), collapse_spaces=collapse_spaces, **kw)
    cleaned = held.withColumn("paragraphs", clean_paragraphs(F.col("__lines"), F.col("messages"), collapse_spaces, dedupe, normal=True))
    return cleaned.drop("__lines").withColumn("clean_text", F.array_join(F.transform("paragraphs", lambda p: p["line"]), "\n"))


def clean_pages(
    pages: DataFrame, messages: DataFrame, site: Profile = FIRST_SITE, series: str | None = None, kinds: str | None = None, status: str | None = None, **kw
) -> DataFrame:
    """Raw pages to title, date and text in one path: extraction, series name off the title, messages and repeats out.

    ``series``, ``kinds`` and ``status`` name columns of ``pages``. Pages are told apart by page_id.
    """
    parsed = extract_pages(pages, site, kinds, status)
    held = attach_messages(parsed, messages, doc_id="page_id", lines=normal_lines(F.col("lines"), site.by_paragraph), collapse_spaces=site.by_paragraph, **kw)
    if series is None:
        return finish_pages(held, F.col("messages"), site)
    named = held.join(pages.select("page_id", F.col(series).alias("__series")), "page_id", "left")
    return finish_pages(named, F.col("messages"), site, F.col("__series"))
