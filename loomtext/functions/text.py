"""Speech normalisation: one column expression per rule, no Python workers."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import col, collapse, fold, is_blank, let, pick, quote, quote_replacement, strip
from .numbers import numbers_to_words

BLOCK = r"(?s)<<SPEAKER=[^>]+>>.*?<</SPEAKER>>"
_BLOCK_SPEAKER = r"(?s)^<<SPEAKER=([^>]+)>>"
_BLOCK_CONTENT = r"(?s)^<<SPEAKER=[^>]+>>(.*)<</SPEAKER>>$"


def replace_characters(text: Column | str) -> Column:
    """Character table in its order. A plain replace passes over a text without the character fast."""
    text = col(text)
    for k, v in fixed.SPEECH_CHARACTERS:
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def tighten_commas(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"(?U)\s+,", ",")


def tighten_punctuation(text: Column | str) -> Column:
    """Drop the space that inline tags leave before punctuation."""
    return F.regexp_replace(col(text), r""" ([,.!?;:'"])""", "$1")


def replace_words(text: Column | str, words: Column | str) -> Column:
    """Whole-word replacements from a map column, case-sensitive, in map order; NULL map: no change."""
    text, words = col(text), col(words)

    def step(acc, e):
        pattern = F.concat(F.lit(r"(?U)\b"), quote(e["key"]), F.lit(r"\b"))
        return F.when(
            F.contains(acc, e["key"]), F.regexp_replace(acc, pattern, quote_replacement(e["value"]))
        ).otherwise(acc)

    return F.coalesce(fold(F.map_entries(words), text, step), text)


def _any_case(word: str) -> str:
    """A pattern for a word in any case; the long s counts as an s, as in Unicode case folding."""
    return "".join(f"[{c}{c.upper()}{'\u017f' if c == 's' else ''}]" if c.isalpha() else c for c in word)


def _acronym_patterns() -> list[tuple[str, str]]:
    """One pattern per spoken form. The letters come first and the word edges after them, because
    a word edge is costly to test at every position. Forms hold no acronym, so order is free."""
    by_form: dict[str, list[str]] = {}
    for short, spoken in fixed.ACRONYMS:
        by_form.setdefault(spoken, []).append(rf"{_any_case(short)}(?<=(?U:\b).{{{len(short)}}})")
    return [(rf"(?:{'|'.join(shorts)})(?U:\b)", spoken) for spoken, shorts in by_form.items()]


def expand_acronyms(text: Column | str, expand_at_tags: bool = False) -> Column:
    """Spell acronyms outside tags. One that touches a tag is left alone unless asked for."""
    text = col(text)
    tag = r"<<[^>]+>>"
    maybe = "|".join(_any_case(short) for short, _ in fixed.ACRONYMS)

    def spell(part):
        for pattern, spoken in _acronym_patterns():
            part = F.regexp_replace(part, pattern, spoken)
        return part

    def guarded(part, i, last):
        """A word character on the side of a tag takes the word edge away there."""
        if expand_at_tags:
            return spell(part)
        left = F.when(i > 0, F.lit("_")).otherwise(F.lit(""))
        right = F.when(i < last, F.lit("_")).otherwise(F.lit(""))
        return let(
            spell(F.concat(left, part, right)),
            lambda padded: F.substring(
                padded, F.length(left) + 1, F.length(padded) - F.length(left) - F.length(right)
            ),
        )

    def weave(both):
        return F.array_join(
            F.transform(
                both["gaps"],
                lambda p, i: F.concat(
                    guarded(p, i, F.size(both["gaps"]) - 1), F.coalesce(pick(both["tags"], i), F.lit(""))
                ),
            ),
            "",
        )

    both = F.struct(
        F.split(text, tag, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({tag})"), F.lit(1)).alias("tags")
    )
    spelled = F.when(F.contains(text, F.lit("<<")), let(both, weave)).otherwise(spell(text))
    return F.when(text.rlike(maybe), spelled).otherwise(text)


def unwrap_brackets(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\[(.*?)\]", "$1")


def speak_ratios(text: Column | str, strict_dates: bool = False) -> Column:
    """``a/b`` to ``a out of b``. Dates are rewritten too unless ``strict_dates`` is set."""
    text = col(text)
    guard = r"(?<![\d/])(?<!/\s)" if strict_dates else ""
    tail = r"(?!\d|\s*/\s*\d)" if strict_dates else r"(?!\s*/\s*\d)"
    spoken = F.regexp_replace(text, rf"(?U){guard}(\d+)\s*/\s*(\d+){tail}", "$1 out of $2")
    return F.when(F.contains(text, F.lit("/")), spoken).otherwise(text)


def speak_signs(text: Column | str) -> Column:
    """``+5`` to ``plus 5`` and ``-5`` to ``minus 5`` unless a word character is in front."""
    text = F.regexp_replace(col(text), r"\+(?U:(?<!\w\+)(\d))", "plus $1")
    return F.regexp_replace(text, r"-(?U:(?<!\w-)(\d))", "minus $1")


def merge_speaker_blocks(text: Column | str) -> Column:
    """Join neighbouring blocks of one speaker that only white space separates.

    Works on the document's own arrays of blocks and of the text between them, so there is
    no shuffle and no fold: each block looks at the one before it.
    """
    text = col(text)

    def build(b):
        blocks, gaps = b["blocks"], b["gaps"]

        def piece(x, i):
            same = (
                (i > 0)
                & (x["speaker"] == pick(blocks, i - 1)["speaker"])
                & is_blank(pick(gaps, i))
            )
            opened = F.concat(
                F.when(i > 0, F.lit("<</SPEAKER>>")).otherwise(F.lit("")),
                pick(gaps, i),
                F.lit("<<SPEAKER="),
                x["speaker"],
                F.lit(">>"),
                x["content"],
            )
            return F.when(F.coalesce(same, F.lit(False)), F.concat(F.lit("\n"), x["content"])).otherwise(opened)

        return F.concat(
            F.array_join(F.transform(blocks, piece), ""), F.lit("<</SPEAKER>>"), F.element_at(gaps, -1)
        )

    blocks = F.transform(
        F.regexp_extract_all(text, F.lit(f"({BLOCK})"), F.lit(1)),
        lambda b: F.struct(
            F.regexp_extract(b, _BLOCK_SPEAKER, 1).alias("speaker"),
            strip(F.regexp_extract(b, _BLOCK_CONTENT, 1)).alias("content"),
        ),
    )
    both = F.struct(blocks.alias("blocks"), F.split(text, BLOCK, -1).alias("gaps"))
    return F.when(F.contains(text, F.lit("<<SPEAKER=")) & text.rlike(BLOCK), let(both, build)).otherwise(text)


def _then(value: Column, step) -> Column:
    return let(value, lambda t: step(t))


def clean_for_speech(text: Column | str, words: Column | str | None = None) -> Column:
    """The full cleaning, in its fixed order.

    The steps are chained through ``let`` so that a step that reads its input twice does not
    double the work of the steps before it.
    """
    steps = [merge_speaker_blocks, replace_characters, tighten_commas]
    if words is not None:
        steps.append(lambda t: replace_words(t, words))
    steps += [expand_acronyms, unwrap_brackets, speak_ratios, speak_signs, numbers_to_words]
    out = col(text)
    for step in steps:
        out = _then(out, step)
    return out


def parts_of(text: Column | str, keep_empty_blocks: bool = False) -> Column:
    """Ordered parts of a tagged text: array<struct<part_pos, tagged, speaker, content>>.

    Blank parts are dropped before positions are given. A block with nothing in it is dropped;
    with ``keep_empty_blocks`` it is kept as untagged markup.
    """
    text = col(text)
    kind = "struct<tagged:boolean,speaker:string,content:string>"

    def plain(t):
        return F.struct(
            F.lit(False).alias("tagged"), F.lit(None).cast("string").alias("speaker"), t.alias("content")
        )

    def block(b):
        content = F.regexp_extract(b, _BLOCK_CONTENT, 1)
        tagged = F.struct(
            F.lit(True).alias("tagged"),
            F.regexp_extract(b, _BLOCK_SPEAKER, 1).alias("speaker"),
            content.alias("content"),
        )
        if keep_empty_blocks:
            return F.when(content == "", plain(b)).otherwise(tagged)
        return tagged

    blocks = F.transform(F.regexp_extract_all(text, F.lit(f"({BLOCK})"), F.lit(1)), block)

    def interleave(bs):
        gaps = F.split(text, BLOCK, -1)
        pairs = F.transform(
            gaps,
            lambda g, i: F.when(pick(bs, i).isNull(), F.array(plain(g).cast(kind))).otherwise(
                F.array(plain(g).cast(kind), pick(bs, i).cast(kind))
            ),
        )
        if keep_empty_blocks:
            keep = lambda x: x["tagged"] | ~is_blank(x["content"])
        else:
            keep = lambda x: F.when(x["tagged"], x["content"] != "").otherwise(~is_blank(x["content"]))
        return F.filter(F.flatten(pairs), keep)

    return F.transform(
        let(blocks, interleave),
        lambda x, i: F.struct(
            i.alias("part_pos"), x["tagged"].alias("tagged"), x["speaker"].alias("speaker"), x["content"].alias("content")
        ),
    )


def content_chars(parts: Column) -> Column:
    """Characters of content over the parts of a document, markup not counted."""
    return fold(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + F.length(p["content"]))


def cut_messages(line: Column, messages: Column, collapse_spaces: bool = True) -> Column:
    """Cut every message of the array out of a line, in array order."""
    tidy = collapse if collapse_spaces else strip

    def step(acc, m):
        return F.when(F.contains(acc, m), tidy(F.replace(acc, m, F.lit("")))).otherwise(acc)

    return fold(messages, line, step)


def cut_states(line: Column, messages: Column, collapse_spaces: bool = True) -> Column:
    """What is left of a line after each message that is cut out of it: an array of texts, empty without a cut."""
    tidy = collapse if collapse_spaces else strip
    start = F.struct(line.alias("now"), F.array().cast("array<string>").alias("seen"))

    def step(acc, m):
        rest = tidy(F.replace(acc["now"], m, F.lit("")))
        return F.when(
            F.contains(acc["now"], m), let(rest, lambda r: F.struct(r.alias("now"), F.concat(acc["seen"], F.array(r)).alias("seen")))
        ).otherwise(acc)

    return fold(messages, start, step, lambda acc: acc["seen"])


def normal_line(line: Column, collapse_spaces: bool = True) -> Column:
    """A line as messages are compared with it."""
    return tighten_punctuation(collapse(line)) if collapse_spaces else strip(line)


def clean_paragraphs(lines: Column, messages: Column, collapse_spaces: bool = True, dedupe: bool = True, normal: bool = False) -> Column:
    """Boilerplate and repeats out of a document's lines: array<struct<pos, line>>. ``normal`` says that the lines are normalised.

    A line that equals a message goes, messages inside a line are cut, empty lines go. With
    ``dedupe`` a line seen before goes, but a line that had a message cut out stays.
    Repeats are found by sorting (line, pos) inside the row: n log n, and no shuffle.
    """
    entries = F.filter(
        F.transform(lines, lambda x, i: F.struct((x if normal else normal_line(x, collapse_spaces)).alias("raw"), i.alias("pos"))),
        lambda e: (e["raw"] != "") & ~F.array_contains(messages, e["raw"]),
    )
    cut = F.filter(
        F.transform(
            entries,
            lambda e: let(
                cut_messages(e["raw"], messages, collapse_spaces),
                lambda c: F.struct(c.alias("line"), e["pos"].alias("pos"), (c != e["raw"]).alias("changed")),
            ),
        ),
        lambda e: e["line"] != "",
    )
    result = lambda es: F.transform(es, lambda e: F.struct(e["pos"].alias("pos"), e["line"].alias("line")))
    if not dedupe:
        return result(cut)

    def firsts(es):
        return F.filter(
            es, lambda e, i: e["changed"] | (i == 0) | (e["line"] != pick(es, i - 1)["line"])
        )

    return let(
        cut,
        lambda es: F.when(
            F.size(F.array_distinct(F.transform(es, lambda e: e["line"]))) == F.size(es), result(es)
        ).otherwise(F.array_sort(result(let(F.array_sort(es), firsts)))),
    )


def inner_words(message: str) -> list[str]:
    """Words with a word on both sides: a text that holds the message holds them as words, in a row."""
    return re.split(r"\s+", message, flags=re.ASCII)[1:-1]


def run_hash(*words: str) -> int:
    """Hash of a run of words, as ``word_runs`` makes it."""
    seed = 42
    for word in words:
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def anchor_run(message: str) -> int | None:
    """The longest run of two inner words by its hash; of a message with one inner word, that word; else none."""
    inner = inner_words(message)
    runs = list(zip(inner, inner[1:])) or [(w,) for w in inner if w]
    return run_hash(*max(runs, key=lambda r: sum(map(len, r)))) if runs else None


def word_runs(words: Column, singles: bool) -> Column:
    """Hashes of every two words in a row, and of single words when asked for."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))
    return F.concat(pairs, F.transform(words, lambda w: F.xxhash64(w))) if singles else pairs


def constant_list(values: list[str]) -> Column:
    """A constant array from one literal: thousands of literals would slow down planning."""
    if not values:
        return F.array().cast("array<string>")
    used = set("".join(values))
    mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)
    return F.split(F.lit(mark.join(values)), mark, -1)


def occurring(messages: list[str], text: Column) -> Column:
    """The messages of a bounded list that occur in a text, in list order.

    One pass hashes the text's runs of two words and meets them with the messages' anchor runs; a run that is there leads to the
    messages filed under it, and only those are looked for. Messages without an inner word are always looked for.
    """
    if not messages:
        return F.array().cast("array<string>")
    filed: dict[int | None, list[int]] = {}
    for i, m in enumerate(messages):
        filed.setdefault(anchor_run(m), []).append(i)
    loose = filed.pop(None, [])
    # messages by anchor: the k-th anchor's are ``many[k]`` entries from ``first[k]``
    order = [i for group in filed.values() for i in group]
    numbers = lambda values: constant_list([str(v) for v in values]).cast("array<bigint>")
    listed = lambda at: F.arrays_zip(numbers(at).alias("i"), constant_list([messages[i] for i in at]).alias("m"))
    many = [len(group) for group in filed.values()]
    first = [1 + sum(many[:k]) for k in range(len(many))]
    anchors, entries = numbers(filed), listed(order)
    singles = any(len(inner_words(m)) == 1 for m in messages)

    def under(anchor):
        return let(
            F.array_position(anchors, anchor).cast("int"),
            lambda k: F.slice(entries, F.get(numbers(first).cast("array<int>"), k - 1), F.get(numbers(many).cast("array<int>"), k - 1)),
        )

    def present(candidates):
        return F.filter(candidates, lambda e: F.contains(text, e["m"]))

    found = []
    if filed:
        hits = let(F.split(text, r"\s+"), lambda words: F.array_intersect(word_runs(words, singles), anchors))
        found.append(F.flatten(F.transform(hits, lambda a: present(under(a)))))
    if loose:
        found.append(present(listed(loose)))
    both = found[0] if len(found) == 1 else F.concat(*found)
    return F.transform(F.array_sort(both), lambda e: e["m"])


def closed_messages(messages: list[str], lines: Column, collapse_spaces: bool = True) -> Column:
    """The messages that occur in the lines or in what cutting them leaves, in list order: cutting these is cutting all.

    The states between the cuts are searched too. Where they bring in another message, which a cut has joined from two ends,
    the whole list is given.
    """
    none = F.array().cast("array<string>")
    if not messages:
        return none
    joined = lambda texts: F.array_join(texts, "\n")

    def close(now):
        states = F.array_distinct(F.flatten(F.transform(lines, lambda x: cut_states(x, now, collapse_spaces))))
        more = let(joined(states), lambda after: F.size(F.array_except(occurring(messages, after), now)) > 0)
        return F.when(F.size(now) == 0, none).when(more, constant_list(messages)).otherwise(now)

    return let(let(joined(lines), lambda text: occurring(messages, text)), close)
