"""Listings against stored chapters, re-read text against stored text, and repairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import decode_file_name, normal_url, strip_series, title_key
from .ranking import attach, row_number_by, successor, unless_null


def listing_keys(toc: DataFrame, key: Column) -> DataFrame:
    """(series, key, url): the first listed entry of each title key."""
    return toc.withColumn("key", key).groupBy("series", "key").agg(F.min_by("url", "pos").alias("resolved"))


def resolve_urls(chapters: DataFrame, toc: DataFrame, strip_names: bool = True) -> DataFrame:
    """Add ``resolved``: the address of the first listed entry with the chapter's title key.

    The listing is reduced to one row a key before the join, so the join cannot multiply rows;
    a title that very many chapters share is split by AQE.
    """
    key = lambda c: title_key(c, "series" if strip_names else None)
    return attach(chapters.withColumn("key", key("title")), listing_keys(toc, key("link_text")), ["series", "key"], ["resolved"]).drop("key")


def fill_urls(chapters: DataFrame, toc: DataFrame, strip_names: bool = True) -> DataFrame:
    """Fill missing or empty source addresses; others are kept."""
    full = F.nullif(F.col("source_url"), F.lit(""))
    rows = resolve_urls(chapters, toc, strip_names)
    return rows.withColumn("source_url", F.coalesce(full, "resolved", "source_url")).drop("resolved")


def dates_with_fallback(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """Listed date of the chapter's address, its own date when the listing has none.

    The last listed non-empty date of an address wins.
    """
    dates = toc.where("pub_date is not null and pub_date <> ''").groupBy("url").agg(F.max_by("pub_date", "pos").alias("__date"))
    key = unless_null(F.col("source_url"), F.col("id"))
    rows = chapters.join(dates.withColumnRenamed("url", "__url"), key == F.col("__url"), "left")
    return rows.withColumn("published_date", F.coalesce("__date", "published_date")).drop("__date", "__url")


def distinct_links(links: DataFrame) -> DataFrame:
    """Links in order, the first of each address kept."""
    rest = [c for c in links.columns if c != "url"]
    return links.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("page", "pos")).alias("r")).select("url", "r.*")


def next_listed(current: DataFrame, toc: DataFrame, block: int = 65536, hot_rows: int = 1_000_000) -> DataFrame:
    """Add ``next_url``: the entry after the first listed one that matches and has a successor."""
    ranked = row_number_by(toc, ["series"], [F.asc("pos")], [F.expr(f"pos div {block * 4096}"), F.expr(f"pos div {block}")], "rn", hot_rows)
    linked = successor(ranked, ["series"], "rn", {"url": "next_url"}).where("next_url is not null")
    first = linked.withColumn("norm", normal_url("url")).groupBy("series", "norm").agg(F.min_by("next_url", "pos").alias("next_url"))
    return attach(current.withColumn("norm", normal_url("url")), first, ["series", "norm"], ["next_url"]).drop("norm")


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose text changed and rows that are gone at the source.

    ``new`` has (id, new_text, available): true read, false gone, NULL when reading failed.
    Rows without an address and rows whose reading failed are in neither group.
    """
    rows = old.where(F.coalesce(F.col("source_url") != "", F.lit(False))).join(new, "id")
    change = F.when(~F.col("available"), F.lit("unavailable")).when(
        F.col("available") & ~F.coalesce("old_text", F.lit("")).eqNullSafe(F.col("new_text")), F.lit("changed")
    )
    return rows.withColumn("change", change).where("change is not null")


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(
        F.count_if(F.col("change") == "changed").alias("changed"),
        F.count_if(F.col("change") == "unavailable").alias("unavailable"),
    )


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def line_diff(changed: DataFrame, key: str = "id", context: int = 3) -> DataFrame:
    """Unified line diff per changed document: added, removed and the diff's lines.

    Only rows that differ get here (the comparison above is native), one document at a time.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for old, new in zip(pdf["old_text"], pdf["new_text"]):
                a, b = (old or "").splitlines(), (new or "").splitlines()
                # junk detection off: it would change which lines match in long texts
                groups = list(difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context))
                lines, added, removed = [], 0, 0
                if groups:
                    lines += [("header", "--- Current"), ("header", "+++ New")]
                for group in groups:
                    (_, i1, _, j1, _), (_, _, i2, _, j2) = group[0], group[-1]
                    at = lambda lo, hi: f"{lo + 1 if hi > lo else lo},{hi - lo}"
                    lines.append(("hunk", f"@@ -{at(i1, i2)} +{at(j1, j2)} @@"))
                    for tag, x1, x2, y1, y2 in group:
                        if tag == "equal":
                            lines += [("ctx", " " + t) for t in a[x1:x2]]
                            continue
                        lines += [("del", "-" + t) for t in a[x1:x2]] + [("add", "+" + t) for t in b[y1:y2]]
                        removed, added = removed + x2 - x1, added + y2 - y1
                rows.append((added, removed, [{"kind": k, "text": t} for k, t in lines]))
            yield pd.DataFrame(
                {key: pdf[key], "added": [r[0] for r in rows], "removed": [r[1] for r in rows], "lines": [r[2] for r in rows]}
            )

    kind = changed.schema[key].dataType.simpleString()
    return changed.select(key, "old_text", "new_text").mapInPandas(
        run, f"{key} {kind}, added bigint, removed bigint, lines array<struct<kind:string,text:string>>"
    )


def line_counts(changed: DataFrame, key: str = "id") -> DataFrame:
    """Lines added and removed as multisets: a lower bound of the diff's counts, without Python."""
    signed = changed.select(
        key,
        F.explode(
            F.concat(
                F.transform(F.split(F.coalesce("old_text", F.lit("")), "\n"), lambda t: F.struct(t.alias("line"), F.lit(-1).alias("n"))),
                F.transform(F.split(F.coalesce("new_text", F.lit("")), "\n"), lambda t: F.struct(t.alias("line"), F.lit(1).alias("n"))),
            )
        ).alias("s"),
    )
    net = signed.groupBy(key, "s.line").agg(F.sum("s.n").alias("n"))
    return net.groupBy(key).agg(
        F.sum(F.greatest(F.col("n"), F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed")
    )


def apply_texts(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """New text where there is an edit, of several the last by ``seq``; ``edited`` says which rows' derived data is void."""
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    last = edits.groupBy("id").agg(F.max_by(F.struct("new_text"), seq).alias("__last"))
    last = last.select("id", F.col("__last.new_text").alias("__new"), F.lit(True).alias("__hit"))
    rows = texts.join(last, "id", "left")
    hit = F.col("__hit").isNotNull()
    return rows.withColumn("text", F.when(hit, F.col("__new")).otherwise(F.col("text"))).withColumn("edited", hit).drop("__new", "__hit")


def drop_derived(derived: DataFrame, edits: DataFrame, key: str = "id") -> DataFrame:
    return derived.join(edits.select(key).distinct(), key, "left_anti")


def title_fixes(files: DataFrame) -> DataFrame:
    """Files whose title still holds the series name: (id, raw_path, old_title, new_title, new_path).

    ``files`` is (id, series, raw_path) of raw files that exist.
    """
    name = F.regexp_replace("raw_path", r"^.*/", "")
    base = F.regexp_replace(name, r"\.txt$", "")
    parts = decode_file_name(base)
    rows = files.where(F.endswith("raw_path", F.lit(".txt")) & ~F.endswith("raw_path", F.lit("_cleaned.txt")))
    rows = rows.select("id", "series", "raw_path", parts["published_date"].alias("date"), parts["title"].alias("old_title"))
    rows = rows.where("date is not null").withColumn("new_title", strip_series("old_title", "series"))
    folder = F.regexp_replace("raw_path", r"[^/]*$", "")
    return rows.where("new_title <> old_title").withColumn("new_path", F.concat(folder, "date", F.lit("_"), "new_title", F.lit(".txt")))


def apply_title_fixes(chapters: DataFrame, fixes: DataFrame, outputs: DataFrame, now: Column) -> DataFrame:
    """New path and title where (id, old path) still matches; an output that exists and has the old file's name moves along."""
    hit = fixes.select("id", F.col("raw_path").alias("__old"), F.col("new_title").alias("__title"), F.col("new_path").alias("__path"))
    rows = chapters.join(hit, (chapters["id"] == hit["id"]) & (chapters["raw_path"] == hit["__old"]), "left").drop(hit["id"])
    there = outputs.select(F.col("path").alias("__out")).distinct()
    rows = rows.join(there, unless_null(F.col("output_path"), F.col("raw_path")) == F.col("__out"), "left")
    done = F.col("__path").isNotNull()
    moved = F.concat(
        F.regexp_replace("output_path", r"[^/]*$", ""),
        F.regexp_replace(F.regexp_replace("__path", r"^.*/", ""), r"\.txt$", ""),
        F.regexp_extract("output_path", r"(\.[^./]*)$", 1),
    )
    stem = lambda c, ends: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), ends, "")
    own = (stem("output_path", r"\.(mp3|wav)$") == stem("__old", r"\.txt$")) & F.col("output_path").rlike(r"\.(mp3|wav)$")
    new = {
        "raw_path": F.coalesce("__path", "raw_path"),
        "title": F.coalesce("__title", "title"),
        "output_path": F.when(done & own & F.col("__out").isNotNull(), moved).otherwise(F.col("output_path")),
        "updated_at": F.when(done, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in chapters.columns])


def changed_cursors(cursors: DataFrame) -> DataFrame:
    return cursors.where(~F.col("before").eqNullSafe(F.col("after")))


def merge_cursors(fresh: DataFrame, cursors: DataFrame) -> DataFrame:
    """Three-way merge: only values the job changed go onto the fresh copy."""
    moved = changed_cursors(cursors).select("name", F.col("after").alias("__after"), F.lit(True).alias("__hit"))
    rows = fresh.join(moved, "name", "left")
    return rows.withColumn("latest", F.when(F.col("__hit").isNotNull(), F.col("__after")).otherwise(F.col("latest"))).drop("__after", "__hit")


