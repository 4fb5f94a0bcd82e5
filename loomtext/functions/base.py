"""Small column helpers shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


# white space as Python's text methods know it
SPACES = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends (Spark's plain trim removes spaces only)."""
    return F.trim(col(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """Runs of white space become one space; the ends are stripped.

    Only runs that are not a single space already are rewritten, which most text has none of.
    """
    return strip(F.regexp_replace(col(c), r"(?U)[\s\x1c-\x1f]{2,}|[[\s\x1c-\x1f]&&[^ ]]", " "))


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


def quote(c: Column) -> Column:
    """A regular expression that matches the text of ``c`` literally."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|/#&~\-])", r"\\$1")


def quote_replacement(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def fold(arr: Column, zero: Column, step, finish=None) -> Column:
    return F.aggregate(arr, zero, step, finish) if finish else F.aggregate(arr, zero, step)


def explode_rows(df: DataFrame, array: Column, name: str, *keep) -> DataFrame:
    """One row per element.

    A plain explode makes Spark derive a filter on the array's size and push it below, which
    evaluates the whole array expression once more per row; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, array: Column, pos: str, name: str, *keep) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def pick(arr: Column, i: Column) -> Column:
    """Zero-based element, NULL out of range."""
    return F.get(arr, i)
