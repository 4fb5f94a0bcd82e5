"""Sentences without a trained model at hand: abbreviations and sentence starters are learnt from the corpus itself.

After Kiss and Strunk (2006). An abbreviation is a word that nearly always has a full stop behind it, that is short, and that may
hold inner full stops; a starter is a word that stands after sentence ends far more often than chance has it. Both are
log-likelihood ratios of counts, which Spark adds up over all texts; the lists that come out are short and become literals of a
column expression, so that splitting stays in the document's row.

The ratios grow with the corpus, so counts enter as rates once they are large (``WORD_COUNT``, ``TOKENS``): a corpus twice the
size gives the same lists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import col, explode_rows, let, pick, strip
from ..functions.text import constant_list
from ..session import cut_lineage

OPENING, CLOSING = "\"'([{“‘", "\"')]}”’"
#: least score of an abbreviation, least ratio of a starter, and the share of full stops that the ratio tests a word for
LEAST_SCORE, LEAST_RATIO, SURE = 0.3, 30.0, 0.99
#: a word with more occurrences counts as one with so many at the same rate; a larger corpus as one of so many tokens
WORD_COUNT, TOKENS = 1_000, 1_000_000
#: longest lists that become literals
MAX_WORDS = 5_000
_MARK, _UNKNOWN = "\ufdd0", "\ufffd"


@dataclass(frozen=True)
class SentenceModel:
    abbreviations: tuple[str, ...]
    starters: tuple[str, ...]


def bare(token: Column) -> Column:
    """A token without quotes, brackets and marks around it, its full stop left on."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING + ",;:!?"))


def word_type(token: Column) -> Column:
    """The word of a token in lower case, without one full stop behind it."""
    word = bare(token)
    return F.lower(F.when(F.endswith(word, F.lit(".")), F.left(word, F.length(word) - 1)).otherwise(word))


def _ends(token: Column) -> Column:
    """A token's end without what closes quotes and brackets."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def _kind(token: Column, abbreviations: Column) -> Column:
    """What the end of a token says: 'end', 'short' (abbreviation or initial), 'number', 'dots' or nothing."""

    def stopped(word):
        return (
            F.when(F.array_contains(abbreviations, word) | word.rlike(r"(?U)^\p{L}$"), "short")
            .when(word.rlike(r"^[-+]?[0-9]+([.,][0-9]+)*$"), "number")
            .otherwise("end")
        )

    def told(end):
        last = F.right(end, F.lit(1))
        return (
            F.when(last.isin("!", "?"), "end")
            .when(F.endswith(end, F.lit("..")), "dots")
            .when(last != ".", "")
            .otherwise(let(word_type(token), stopped))
        )

    return let(_ends(token), told)


def _last_token(text: Column) -> Column:
    """The last token of a text that does not end in white space; only what follows the last plain space is searched."""
    return F.regexp_extract(F.substring_index(text, " ", -1), r"(?U)(\S++)$", 1)


def _first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)^\s*+(\S++)", 1)


def _marked(text: Column, ends: str) -> Column:
    """Parts of a text, cut behind what matches ``ends``. The noncharacter U+FDD0 reads as U+FFFD."""
    plain = F.replace(text, F.lit(_MARK), F.lit(_UNKNOWN))
    return F.split(F.regexp_replace(plain, rf"(?U)({ends})", f"$1{_MARK}"), _MARK, -1)


def _log(p: Column, n: Column) -> Column:
    """n * ln(p), nought for no occurrence."""
    return F.when(n > 0, n * F.ln(F.when(p > 0, p))).otherwise(0.0)


def count_types(texts: DataFrame, text: str = "text") -> DataFrame:
    """(type, n, stopped): occurrences of each word type, and how many have a full stop behind them."""
    tokens = explode_rows(texts, F.split(text, r"(?U)\s+"), "token").where("token != ''")
    # first whole tokens, which combine before the shuffle, then their types
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    typed = counted.select(word_type(F.col("token")).alias("type"), "n", F.endswith(bare(F.col("token")), F.lit(".")).alias("dot"))
    return typed.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("stopped"))


def abbreviation_scores(types: DataFrame) -> DataFrame:
    """(type, n, stopped, score) for types of letters with a full stop somewhere behind them."""
    total, stops = types.agg(F.sum("n"), F.sum("stopped")).first()
    if not stops or stops == total:
        return types.limit(0).withColumn("score", F.lit(0.0))
    share = stops / total
    scale = F.least(F.lit(1.0), F.lit(float(WORD_COUNT)) / F.col("n"))
    yes, no = F.col("stopped") * scale, (F.col("n") - F.col("stopped")) * scale
    chance = yes * F.ln(F.lit(share)) + no * F.ln(F.lit(1 - share))
    surely = yes * F.ln(F.lit(SURE)) + no * F.ln(F.lit(1 - SURE))
    letters = F.length(F.replace("type", F.lit("."), F.lit(""))).cast("double")
    inner = F.length("type") - letters
    score = 2 * (surely - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters, -no)
    shaped = types.where((F.col("stopped") > 0) & F.col("type").rlike(r"(?U)^\p{L}[\p{L}\p{M}]*(\.\p{L}[\p{L}\p{M}]*)*$"))
    return shaped.withColumn("score", score)


def starter_scores(texts: DataFrame, types: DataFrame, abbreviations: list[str], text: str = "text") -> DataFrame:
    """(type, n, after, score): how often a word stands behind a sentence end, and the ratio that speaks for more than chance."""

    def pairs(parts):
        # neither character stands in a word of letters, so reading one for the other changes no count
        return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p, i: F.struct(_last_token(pick(parts, i)).alias("a"), _first_token(p).alias("b")))

    rows = explode_rows(texts, let(_marked(col(text), r"[.!?](?<![.!?]{2})\p{Punct}*+(?=\s++\S)"), pairs), "p")
    counted = rows.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("k"))
    ends = cut_lineage(counted.where(_kind(F.col("a"), constant_list(abbreviations)) == "end").groupBy(word_type(F.col("b")).alias("type")).agg(F.sum("k").alias("after")))
    (breaks,) = ends.agg(F.coalesce(F.sum("after"), F.lit(0))).first()
    (total,) = types.agg(F.sum("n")).first()
    if not breaks or breaks == total:
        return types.limit(0).select("type", "n", F.lit(0).cast("bigint").alias("after"), F.lit(0.0).alias("score"))
    f = min(1.0, TOKENS / total)
    both, word = F.col("after") * f, F.col("n") * f
    tokens, before = F.lit(total * f), F.lit(breaks * f)
    p, p1, p2 = word / tokens, both / before, (word - both) / (tokens - before)

    def likely(p_after, p_else):
        """Of the word behind ends with one rate, and elsewhere with another."""
        behind = _log(p_after, both) + _log(1 - p_after, before - both)
        return behind + _log(p_else, word - both) + _log(1 - p_else, tokens - before - word + both)

    found = ends.join(types, "type").where(F.col("type").rlike(r"(?U)^\p{L}+$") & (F.col("after") * total > F.col("n") * breaks))
    return found.select("type", "n", "after", (2 * (likely(p1, p2) - likely(p, p))).alias("score"))


def learn_sentences(texts: DataFrame, text: str = "text") -> SentenceModel:
    """Abbreviations and starters of all texts. Null and empty texts count for nothing; without any full stop both lists are empty.

    More than ``MAX_WORDS`` words of one kind are an error: the texts are then no prose."""
    types = cut_lineage(count_types(texts, text))
    short = _words(abbreviation_scores(types).where(F.col("score") >= LEAST_SCORE))
    starters = _words(starter_scores(texts, types, short, text).where(F.col("score") >= LEAST_RATIO))
    return SentenceModel(tuple(short), tuple(starters))


def _words(scored: DataFrame) -> list[str]:
    words = [r[0] for r in scored.select("type").orderBy("type").limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words look alike")
    return words


def split_sentences(text: Column | str, model: SentenceModel) -> Column:
    """Sentences in order, stripped, none empty: an array of texts, NULL for a null text.

    A text may end a sentence at white space behind '.', '!' or '?' and what closes after it. It does not behind an abbreviation or a
    single letter, unless a starter with a capital follows; nor behind a number before a small letter, nor behind dots unless a
    capital follows. The noncharacter U+FDD0 reads as U+FFFD.
    """
    abbreviations, starters = constant_list(list(model.abbreviations)), constant_list(list(model.starters))

    def ends(before, after):
        def told(kind, first):
            head = F.ltrim(first, F.lit(OPENING))
            capital, small = head.rlike(r"(?U)^\p{Lu}"), head.rlike(r"(?U)^\p{Ll}")
            return (
                ((kind == "short") & capital & F.array_contains(starters, word_type(first)))
                | ((kind == "number") & ~small)
                | ((kind == "dots") & capital)
            )

        kind = let(_last_token(before), lambda last: _kind(last, abbreviations))
        return let(kind, lambda k: (k == "end") | let(_first_token(after), lambda first: told(k, first)))

    def weave(parts):
        cut = F.transform(parts, lambda p, i: F.when((i == 0) | ~ends(pick(parts, i - 1), p), p).otherwise(F.concat(F.lit(_MARK), p)))
        return F.split(F.array_join(cut, ""), _MARK, -1)

    whole = let(_marked(col(text), rf"[.!?][{re.escape(CLOSING)}]{{0,4}}+(?=\s)"), weave)
    return F.filter(F.transform(whole, strip), lambda s: s != "")
