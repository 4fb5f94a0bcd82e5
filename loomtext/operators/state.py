"""State tables: look-ups, reports, work lists and changes. Each change returns a new snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.titles import decode_file_name
from ..session import broadcast_if_small
from .ranking import in_order, unless_null

_ERROR_CODE = r"(?i)winerror\s*(\d+)"


# look-ups and projections


def chapter_by_id(chapters: DataFrame, chapter_id: Column) -> DataFrame:
    return chapters.where(F.col("id") == chapter_id)


def chapters_of(chapters: DataFrame, series_id: Column, status: str | None = None) -> DataFrame:
    rows = chapters.where(F.col("series_id") == series_id)
    return (rows.where(F.col("status") == status) if status else rows).orderBy("raw_path")


def enabled(series: DataFrame) -> DataFrame:
    return series.where(F.coalesce("enabled", F.lit(True)))


def with_defaults(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})


def search(df: DataFrame, names: list[str], needle: str) -> DataFrame:
    """Rows with the needle in any of the named columns, in any case."""
    hits = [F.contains(F.lower(F.col(n).cast("string")), F.lit(needle.lower())) for n in names]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def overlay_settings(series: DataFrame, settings: dict) -> DataFrame:
    """Put global settings on each series row; an empty batch size or verbose flag adds nothing."""
    out = series.withColumn("engine", F.lit(settings.get("engine") or "large"))
    if settings.get("batch_size"):
        out = out.withColumn("batch_size", F.lit(int(settings["batch_size"])))
    if settings.get("verbose"):
        out = out.withColumn("verbose", F.lit(True))
    return out


def error_class(error: Column, filename: Column | None = None) -> Column:
    """'network' for errors of a lost share, 'other' for the rest, NULL without an error."""
    share = F.lit("\\\\")
    hit = F.contains(error, share) | F.contains(error, F.lit("disk I/O error"))
    hit = hit | F.regexp_extract(error, _ERROR_CODE, 1).isin([str(c) for c in fixed.NETWORK_CODES])
    if filename is not None:
        hit = hit | F.coalesce(F.contains(filename, share), F.lit(False))
    return F.when(error.isNull(), F.lit(None)).when(hit, F.lit("network")).otherwise(F.lit("other"))


# reports


def status_counts(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per status, zero-filled; one pass with map-side sums, no pivot job."""
    return chapters.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in fixed.STATUSES])


def status_totals(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def done_stats(chapters: DataFrame, now: Column) -> DataFrame:
    done = chapters.where("status = 'done'")
    since = lambda days: F.count_if(F.col("updated_at") >= now - F.expr(f"interval {days} days"))
    return done.agg(
        F.count(F.lit(1)).alias("done_count"),
        (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600).alias("tracked_hours"),
        since(7).alias("done_7d"),
        since(30).alias("done_30d"),
    )


def failed(chapters: DataFrame, series: DataFrame) -> DataFrame:
    """Failed chapters with the name of their series, newest first."""
    names = series.select(F.col("id").alias("series_id"), F.col("name").alias("series_name"))
    return chapters.where("status = 'failed'").join(broadcast_if_small(names), "series_id").orderBy(F.desc("updated_at"), "id")


def dashboard(series: DataFrame, chapters: DataFrame, registered: DataFrame) -> DataFrame:
    """Enabled series with their counts and narrator; an empty narrator falls through to the config."""
    counts = status_counts(chapters, ["series_id"])
    state = registered.select("name", F.col("id").alias("series_id"), F.col("narrator").alias("state_narrator"))
    rows = enabled(series).join(state, "name", "left").join(counts, "series_id", "left")
    return rows.select(
        "name",
        *[F.coalesce(s, F.lit(0)).alias(s) for s in fixed.STATUSES],
        F.coalesce(F.nullif("state_narrator", F.lit("")), "narrator", F.lit("")).alias("narrator"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


def voice_roles(config: DataFrame) -> DataFrame:
    """(series, voice, role) over narrator, mapping values and system voice; a series names a voice once per role."""
    roles = F.array(
        F.struct(F.col("narrator").alias("voice"), F.lit("narrator").alias("role")),
        F.struct(F.col("system_voice").alias("voice"), F.lit("system").alias("role")),
    )
    mapped = F.transform(
        F.array_distinct(F.map_values("mappings")), lambda v: F.struct(v.alias("voice"), F.lit("mapping").alias("role"))
    )
    return (
        config.select("series", F.explode(F.concat(roles, F.coalesce(mapped, F.array().cast("array<struct<voice:string,role:string>>")))).alias("r"))
        .select("series", "r.voice", "r.role")
        .where("voice is not null")
    )


def where_used(voices: DataFrame, config: DataFrame) -> DataFrame:
    """Each known voice with its uses, one row a use; a voice without any keeps one row with NULL.

    Rows rather than one list a voice: a voice used by very many series stays spread out.
    """
    uses = voice_roles(config).select("voice", F.concat("series", F.lit(" ("), "role", F.lit(")")).alias("used_by"))
    return voices.select(F.col("voice_name").alias("voice")).join(uses, "voice", "left")


# work lists


def work_list(chapters: DataFrame, nulls_last: bool = False) -> DataFrame:
    """Pending and failed chapters in working order.

    A missing index counts as 999999, which is below real ids; ``nulls_last`` puts it at the end.
    """
    rows = chapters.where(F.col("status").isin("pending", "failed"))
    index = F.asc_nulls_last("chapter_index") if nulls_last else F.coalesce("chapter_index", F.lit(fixed.MISSING_INDEX)).asc()
    return rows.orderBy(index, "published_date", "raw_path")


def overlay_progress(chapters: DataFrame, progress: DataFrame) -> DataFrame:
    """Percent of the running job on the processing row of its path."""
    live = progress.where("raw_path is not null and pct is not null").select("raw_path", "pct")
    # of several runs of a path the one that is furthest on
    live = live.groupBy("raw_path").agg(F.max("pct").alias("pct"))
    rows = chapters.join(live, "raw_path", "left")
    return rows.withColumn("pct", F.when(F.col("status") == "processing", F.col("pct")))


# changes


def upsert_series(series: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Insert or update by name; a NULL keeps the old value. The stamps move on every call.

    Several rows of one name are calls in the order of ``seq``: each field takes the last value that is not NULL. New rows
    get the ids after the highest one, in the order of their names; rows without a name are left out.
    """
    fields = [c for c in new.columns if c not in ("name", "seq")]
    seq = F.col("seq") if "seq" in new.columns else F.lit(0)
    calls = new.where("name is not null").withColumn("__seq", seq)
    new = calls.groupBy("name").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in fields])
    fresh = in_order(new.select("name").join(series.select("name"), "name", "left_anti").orderBy("name"), "__no")
    new = new.join(fresh, "name", "left")
    highest = F.lit(series.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    old = series.select(*[F.col(c).alias("o_" + c) for c in series.columns])
    rows = old.join(new, F.col("o_name") == F.col("name"), "full_outer")
    touched = F.col("name").isNotNull()
    keep = lambda c: F.coalesce(F.col(c), F.col("o_" + c)).alias(c)
    return rows.select(
        F.coalesce("o_id", highest + F.col("__no")).alias("id"),
        *[keep(c) for c in ["name", "url", "source", "narrator", "latest_url"]],
        F.when(touched, now).otherwise(F.col("o_last_scraped_at")).alias("last_scraped_at"),
        F.coalesce("o_created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("o_updated_at")).alias("updated_at"),
    )


def register(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose path is unseen; of several with one path the first (by ``seq``) wins."""
    fields = [c for c in new.columns if c not in ("raw_path", "seq")]
    first = new.groupBy("raw_path").agg(F.min_by(F.struct(*fields), "seq").alias("r"), F.min("seq").alias("seq"))
    return first.join(chapters.select("raw_path"), "raw_path", "left_anti").select("seq", "raw_path", "r.*")


def missing_series(new: DataFrame, series: DataFrame) -> DataFrame:
    return new.select(F.col("series").alias("name")).distinct().join(series.select("name"), "name", "left_anti")


def apply_transitions(chapters: DataFrame, moves: DataFrame) -> DataFrame:
    """Fold processing / done / failed / checked moves (ordered by seq) into the chapters.

    Everything is an aggregate that combines before the shuffle, so a chapter with very many
    moves costs one row per task.
    """
    kind = F.col("kind")
    last = lambda value, cond: F.max_by(F.struct(value.alias("v")), F.when(cond, F.col("seq")))
    settles = kind.isin("processing", "done", "failed")
    ends = kind.isin("done", "failed")
    with_output = (kind == "processing") | ((kind == "done") & F.coalesce(F.col("output_path") != "", F.lit(False)))
    timed = (kind == "done") & F.coalesce(F.col("output_path") != "", F.lit(False)) & F.col("duration_s").isNotNull()
    folded = moves.groupBy("id").agg(
        last(kind, settles).alias("m_status"),
        last(F.when(kind == "failed", F.col("error")), ends).alias("m_error"),
        last(F.col("output_path"), with_output).alias("m_output"),
        last(F.col("duration_s"), timed).alias("m_duration"),
        last(F.col("ts"), kind == "checked").alias("m_checked"),
        F.max_by("ts", "seq").alias("m_ts"),
        F.count_if(kind == "failed").alias("m_fails"),
    )
    rows = chapters.join(folded, "id", "left")
    over = lambda m, c: F.when(F.col(m).isNotNull(), F.col(m)["v"]).otherwise(F.col(c))
    return rows.select(
        *[
            {
                "status": over("m_status", "status"),
                "error": over("m_error", "error"),
                "output_path": over("m_output", "output_path"),
                "duration_s": over("m_duration", "duration_s"),
                "checked_at": over("m_checked", "checked_at"),
                "updated_at": F.coalesce("m_ts", "updated_at"),
                "retry_count": F.col("retry_count") + F.coalesce("m_fails", F.lit(0)),
            }.get(c, F.col(c)).alias(c)
            for c in chapters.columns
        ]
    )


def reset_processing(chapters: DataFrame, now: Column) -> DataFrame:
    stale = F.col("status") == "processing"
    return chapters.withColumns(
        {"status": F.when(stale, F.lit("pending")).otherwise(F.col("status")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))}
    )


def affected(chapters: DataFrame) -> DataFrame:
    return chapters.agg(F.count_if(F.col("status") == "processing").alias("reset"))


def reset_chapters(chapters: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Back to pending with error and output cleared; the retry count stays."""
    rows = chapters.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull()
    new = {
        "status": F.when(hit, F.lit("pending")).otherwise(F.col("status")),
        "error": F.when(~hit, F.col("error")),
        "output_path": F.when(~hit, F.col("output_path")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in chapters.columns])


def base_name(path: Column) -> Column:
    """Last path element without its extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def with_ids(registered: DataFrame, chapters: DataFrame, series: DataFrame) -> DataFrame:
    """Newly registered rows (see ``register``) with an id after the highest one of the chapters, in the order of ``seq``
    and path, and the id of their series."""
    highest = F.lit(chapters.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    numbered = in_order(registered.orderBy("seq", "raw_path"), "__no")
    ids = series.groupBy(F.col("name").alias("series")).agg(F.min("id").alias("series_id"))
    return numbered.join(ids, "series", "left").withColumn("id", highest + F.col("__no")).drop("__no")


def reconcile(chapters: DataFrame, files: DataFrame, outputs: DataFrame, series: DataFrame, now: Column) -> DataFrame:
    """Bring the state in line with a file listing. Adds ``actions`` (what happened to a row).

    In order: stale processing rows go back to pending; unseen .txt files are registered; a
    row with an output becomes done (.mp3 before .wav); a done row whose recorded output is
    gone goes back to pending; a row whose raw file is gone is deleted. The order is kept by
    deriving each step's status from the step before, so one pass does all five. ``files`` is
    (series_id, raw_path), ``outputs`` is (series_id, path). Files and rows of an unknown series
    are left alone.
    """
    known = broadcast_if_small(series.select(F.col("id").alias("__known")).distinct())
    # a path names one file, under whichever of the known series it is listed
    listed = files.join(known, F.col("series_id") == F.col("__known"), "left_semi")
    listed = listed.groupBy(F.col("raw_path").alias("f_path")).agg(F.min("series_id").alias("f_series"))
    on_disk = outputs.select("series_id", F.col("path").alias("o_path"), base_name(F.col("path")).alias("o_base"))
    best = on_disk.groupBy("series_id", "o_base").agg(
        F.coalesce(
            F.min(F.when(F.endswith("o_path", F.lit(".mp3")), F.col("o_path"))),
            F.min(F.when(F.endswith("o_path", F.lit(".wav")), F.col("o_path"))),
        ).alias("found")
    )
    # what was stored is told by a mark: a registered row may not have its id yet
    stored = chapters.withColumn("__stored", F.lit(True)).join(known, F.col("series_id") == F.col("__known"), "left")
    rows = stored.join(listed, F.col("raw_path") == F.col("f_path"), "full_outer")
    name = base_name(F.col("f_path"))
    fresh = F.col("__stored").isNull()
    usable = F.endswith("f_path", F.lit(".txt")) & ~F.endswith("f_path", F.lit("_cleaned.txt"))
    rows = rows.where(F.col("raw_path").isNotNull() | usable)
    rows = rows.withColumns(
        {
            "__fresh": fresh,
            "__ours": F.col("__known").isNotNull(),
            "__gone": F.col("__known").isNotNull() & F.col("f_path").isNull(),
            "series_id": F.coalesce("series_id", "f_series"),
            "raw_path": F.coalesce("raw_path", "f_path"),
            "title": F.coalesce("title", decode_file_name(name)["title"]),
            "published_date": F.when(fresh, decode_file_name(name)["published_date"]).otherwise(F.col("published_date")),
            "__base": base_name(F.coalesce("raw_path", "f_path")),
        }
    )
    rows = rows.join(best.select(F.col("series_id").alias("b_series"), "o_base", "found"), (F.col("__base") == F.col("o_base")) & (F.col("series_id") == F.col("b_series")), "left")
    there = outputs.select(F.col("path").alias("__there")).distinct()
    rows = rows.join(there, unless_null(F.col("output_path"), F.col("raw_path")) == F.col("__there"), "left")
    ours = F.col("__ours")
    reset = ours & F.coalesce(F.col("status") == "processing", F.lit(False))
    was_done = F.coalesce(F.col("status") == "done", F.lit(False))
    marked = (ours | F.col("__fresh")) & ~was_done & F.col("found").isNotNull()
    reverted = ours & was_done & F.coalesce(F.col("output_path") != "", F.lit(False)) & F.col("__there").isNull()
    flag = lambda cond, text: F.when(cond, F.lit(text)).otherwise(F.lit(""))
    return rows.select(
        "id", "series_id", "title", "published_date", "raw_path",
        F.when(marked, F.lit("done")).when(reverted, F.lit("pending")).when(reset | F.col("__fresh"), F.lit("pending")).otherwise(F.col("status")).alias("status"),
        F.when(marked, F.col("found")).when(reverted, F.lit(None)).otherwise(F.col("output_path")).alias("output_path"),
        F.when(marked | reverted | reset | F.col("__fresh"), now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.array_remove(
            F.array(
                flag(reset, "reset"), flag(F.col("__fresh"), "registered"), flag(marked, "marked"),
                flag(reverted, "reverted"), flag(F.col("__gone"), "removed"),
            ),
            "",
        ).alias("actions"),
    )


def surviving(reconciled: DataFrame) -> DataFrame:
    """The new snapshot: rows that were not removed."""
    return reconciled.where(~F.array_contains("actions", "removed")).drop("actions")


def reconcile_report(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(F.explode("actions").alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def write_once(existing: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Rows of ``new`` with ``written``: true for the first row (by ``seq``) of a key that was not there yet."""
    first = new.groupBy(*keys).agg(F.min(seq).alias("__first")).join(existing.select(*keys), keys, "left_anti")
    rows = new.join(first, keys, "left")
    return rows.withColumn("written", F.coalesce(F.col(seq) == F.col("__first"), F.lit(False))).drop("__first")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key by an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def newest(df: DataFrame, seq: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(seq)).limit(n)


def newest_per_key(df: DataFrame, keys: list[str], seq: str, n: int) -> DataFrame:
    """Newest n rows per key; Spark keeps n rows per key in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def after_cursor(df: DataFrame, seq: str, cursor: Column) -> DataFrame:
    return df.where(F.col(seq) > cursor)


def high_water(df: DataFrame, seq: str, cursor: Column) -> DataFrame:
    return df.agg(F.coalesce(F.greatest(F.max(seq), cursor), cursor).alias("high_water"))
