"""Titles, file names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .base import col, collapse, let, strip


def source_name(url: Column | str) -> Column:
    """Short source name by host substring, 'local' for the literal, NULL otherwise."""
    url = col(url)
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    out = F.when(F.lower(strip(url)) == "local", F.lit("local"))
    for part, name in fixed.SOURCE_HOSTS:
        out = out.when(F.contains(host, F.lit(part)), F.lit(name))
    return out


def normal_url(url: Column | str) -> Column:
    """Trailing slashes go first, then everything from the first '?'."""
    return F.substring_index(F.rtrim(col(url), F.lit("/")), "?", 1)


def index_from_url(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(url), r"/chapter/(\d+)", 1), F.lit("")).cast("bigint")


def publication_date(stamp: Column | str) -> Column:
    """Date part in the stamp's own offset; 'unknown_date' without a stamp."""
    stamp = col(stamp)
    return F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(stamp, 1, 10)).otherwise(F.lit("unknown_date"))


def decode_file_name(base: Column | str) -> Column:
    """``{date}_{title}`` to struct<published_date, title>; no '_' means no date."""
    parts = F.split(col(base), "_", 2)
    return F.struct(
        F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("published_date"),
        F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(col(base)).alias("title"),
    )


def file_safe(text: Column | str) -> Column:
    return F.regexp_replace(col(text), fixed.UNSAFE_FILE_CHARACTERS, "")


def encode_file_name(date: Column | str, title: Column | str) -> Column:
    return F.concat(col(date), F.lit("_"), file_safe(title), F.lit(".txt"))


def plain_title(title: Column | str) -> Column:
    """Title characters to plain ones; applied in table order because keys may overlap."""
    out = col(title)
    for k, v in fixed.TITLE_CHARACTERS:
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def strip_series(title: Column | str, series: Column | str, scan_unsafe_prefix: bool = True) -> Column:
    """Strip the site suffix, a trailing tag, and the series name at the end or the start."""
    title, series = col(title), col(series)
    site = fixed.TITLE_SITE_SUFFIX
    name = F.lower(series)
    safe_name = file_safe(name)

    def has_name(text):
        low = F.lower(text)
        return F.contains(low, name) | F.contains(file_safe(low), safe_name)

    no_site = (
        F.when(F.contains(title, F.lit(f" | {site}")), strip(F.substring_index(title, f" | {site}", 1)))
        .when(F.endswith(title, F.lit(f" {site}")), strip(F.substring(title, F.lit(1), F.length(title) - len(site) - 1)))
        .otherwise(title)
    )
    no_tag = strip(F.regexp_replace(no_site, r"(?U)\s*\[[^\]]*\]\s*$", ""))

    def drop_suffix(t):
        def cut(parts):
            last = F.array_max(
                F.filter(
                    F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                    lambda k: (k < F.size(parts))
                    & has_name(F.array_join(F.slice(parts, k + 1, F.size(parts)), " - ")),
                )
            )
            return F.when(last.isNotNull(), strip(F.array_join(F.slice(parts, F.lit(1), last), " - "))).otherwise(t)

        return F.when(F.contains(t, F.lit(" - ")) & has_name(t), let(F.split(t, " - ", -1), cut)).otherwise(t)

    def drop_prefix(t):
        low = F.lower(t)
        exact = F.startswith(low, name)
        skip = F.length(series)
        hit = exact
        if scan_unsafe_prefix:
            unsafe = fixed.UNSAFE_FILE_CHARACTERS
            safe = "[^" + unsafe[1:]
            # shortest prefix that holds as many safe characters as the safe name has
            pattern = F.concat(F.lit(f"^(?:{unsafe}*{safe}){{"), F.length(safe_name).cast("string"), F.lit("}"))
            scanned = F.length(F.regexp_substr(t, pattern))
            hit = exact | F.startswith(file_safe(low), safe_name)
            skip = F.when(exact, skip).otherwise(F.coalesce(scanned, F.lit(0)))
        rest = strip(F.substring(t, skip + 1, F.length(t)))
        return F.when(hit & (rest != ""), rest).otherwise(t)

    return let(let(no_tag, drop_suffix), drop_prefix)


def title_key(title: Column | str, series: Column | str | None = None) -> Column:
    """Key under which stored titles and listed titles meet. With a series the name is stripped first."""
    out = col(title) if series is None else strip_series(title, series)
    out = F.regexp_replace(F.lower(plain_title(out)), r"(?U)[^\w\s]", "")
    return collapse(out)


def _tokens(text: Column | str) -> Column:
    text = F.coalesce(col(text), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.when(text.rlike("^[0-9]"), F.concat(F.array(F.lit("")), tokens)).otherwise(tokens)


def natural_key(text: Column | str, collation: str | None = None) -> Column:
    """Sort key with digit runs as numbers: array<struct<size, digits, txt>>.

    Digit runs of any length compare by size and then digit by digit. The first element is always
    text, so numbers meet numbers. With a collation the text parts compare under it.
    """
    shown = (lambda x: F.collate(F.lower(x), collation)) if collation else F.lower

    def element(x):
        number = x.rlike("^[0-9]")
        digits = F.when(number, F.regexp_replace(x, "^0+", "")).otherwise(F.lit(""))
        return F.struct(
            F.length(digits).alias("size"),
            digits.alias("digits"),
            shown(F.when(number, F.lit("")).otherwise(x)).alias("txt"),
        )

    return F.transform(_tokens(text), element)


def natural_text(text: Column | str) -> Column:
    """The natural key as one string: each digit run carries its size in front."""

    def element(x):
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(
            x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)
        ).otherwise(F.lower(x))

    return F.array_join(F.transform(_tokens(text), element), "")


def collated_key(text: Column | str) -> Column:
    """Natural key that also ignores case and accents."""
    return natural_key(text, "UNICODE_CI_AI")
