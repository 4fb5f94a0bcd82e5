"""Integers above 99 to English words, as one column expression."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import col, let

_ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
_TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
# The parts that the names of large scales are made of, up to the hundredth
_LOW = "m b tr quadr quint sext sept oct non".split()
_UNITS = ["", *"un duo tre quattuor quin sex sept octo novem".split()]
_DECADES = "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split()
_SCALES = ["", "thousand", *[f"{n}illion" for n in [*_LOW, *[u + d for d in _DECADES for u in _UNITS], "cent"]]]
#: numbers beyond the last named scale have no words; ``unspoken_numbers`` tells of them
MAX_DIGITS = 3 * len(_SCALES)
_ZEROS = [c for c in range(0x80, sys.maxunicode) if unicodedata.decimal(chr(c), None) == 0]
_DIGITS = "".join(chr(z + d) for z in _ZEROS for d in range(10))


def _below_thousand(n: int) -> str:
    """0..999 in words; the word table is built from this rule."""
    hundreds, rest = divmod(n, 100)
    words = []
    if hundreds:
        words.append(f"{_ONES[hundreds]} hundred")
    if rest or not hundreds:
        tens, ones = divmod(rest, 10)
        words.append(_ONES[rest] if rest < 20 else _TENS[tens] + (f"-{_ONES[ones]}" if ones else ""))
    return " and ".join(words)


def _words(digits: Column) -> Column:
    """Words of a digit string without leading zeros and with at least three digits."""
    table = F.array(*[F.lit(_below_thousand(n)) for n in range(1000)])
    scales = F.array(*[F.lit(f" {s}" if s else "") for s in _SCALES])
    padded = F.lpad(digits, (F.ceil(F.length(digits) / F.lit(3)) * 3).cast("int"), F.lit("0"))
    groups = F.regexp_extract_all(padded, F.lit(r"([0-9]{3})"), F.lit(1))

    def named(gs):
        parts = F.transform(
            gs, lambda g, i: F.struct(g.cast("int").alias("n"), (F.size(gs) - 1 - i).alias("p"))
        )
        return F.filter(parts, lambda x: x["n"] > 0)

    def join(parts):
        text = F.transform(parts, lambda x: F.concat(F.get(table, x["n"]), F.get(scales, x["p"])))
        last = F.element_at(parts, -1)
        small_tail = (F.size(parts) > 1) & (last["p"] == 0) & (last["n"] < 100)
        return F.when(
            small_tail,
            F.concat(
                F.array_join(F.slice(text, F.lit(1), F.size(parts) - 1), ", "),
                F.lit(" and "),
                F.element_at(text, -1),
            ),
        ).otherwise(F.array_join(text, ", "))

    return let(groups, lambda gs: let(named(gs), join))


def numbers_to_words(text: Column | str) -> Column:
    """Rewrite each integer above 99 (comma groups accepted); the rest of the text is kept.

    Digits of all scripts count. Numbers of more than MAX_DIGITS digits have no name and stay; see ``unspoken_numbers``.
    """
    text = col(text)

    def rewrite_all(tokens, plain):
        def rewrite(tok):
            digits = F.regexp_replace(plain(tok), "^[0,]+|,", "")
            big = tok.rlike(r"(?U)^\d") & F.length(digits).between(3, MAX_DIGITS)
            return F.when(big, _words(digits)).otherwise(tok)

        return F.array_join(F.transform(tokens, rewrite), "")

    ascii_only = F.regexp_extract_all(text, F.lit(r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+|[^0-9]+)"), F.lit(1))
    any_script = F.regexp_extract_all(text, F.lit(r"((?U:\d{1,3}(?:,\d{3})+|\d+|\D+))"), F.lit(1))
    return (
        F.when(text.rlike(r"(?U)[\d&&[^0-9]]"), rewrite_all(any_script, _ascii_digits))
        .when(text.rlike("[0-9]{3}"), rewrite_all(ascii_only, lambda t: t))
        .otherwise(text)
    )


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, _DIGITS, "0123456789" * len(_ZEROS))


def unspoken_numbers(text: Column | str) -> Column:
    """The numbers of a text that ``numbers_to_words`` has no name for."""
    found = F.regexp_extract_all(col(text), F.lit(r"((?U:\d{1,3}(?:,\d{3})+|\d+))"), F.lit(1))
    return F.filter(found, lambda t: F.length(F.regexp_replace(_ascii_digits(t), "^[0,]+|,", "")) > MAX_DIGITS)
