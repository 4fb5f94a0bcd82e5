"""Job events and log lines: progress, classes, annotations and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import posexplode_rows, strip
from .chains import follow_links
from .ranking import next_after, row_number_by

def split_log(df: DataFrame, text: str = "line", keep_indent: bool = False) -> DataFrame:
    """Log text to lines: colour codes off, cut at line ends and carriage returns, trimmed, blanks dropped.

    Trimming takes away the tab by which a chapter line is told from a plain one; ``keep_indent``
    leaves it for the line classes.
    """
    lines = F.split(F.regexp_replace(text, r"\x1b\[[0-9;]*m", ""), r"[\r\n]", -1)
    rest = [c for c in df.columns if c != text]
    found = posexplode_rows(df, lines, "sub", text, *rest).where(F.col(text).rlike(r"(?U)\S"))
    return found if keep_indent else found.withColumn(text, strip(text))


def parse_line(line: Column) -> Column:
    """struct<kind, text, phase, idx, total>; rules are tried in order."""
    trimmed = F.regexp_replace(line, r"(?U)\s+$", "")
    text = strip(F.regexp_replace(trimmed, r"^\t+", ""))
    queue = F.regexp_extract(text, fixed.LOG_QUEUE, 1)
    series = lambda i: F.regexp_extract(text, fixed.LOG_SERIES, i)
    is_queue, is_series = text.rlike(fixed.LOG_QUEUE), text.rlike(fixed.LOG_SERIES)
    after = lambda prefix: strip(F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
    kind = (
        F.when(is_queue & queue.rlike(r"(?i)^failed\b"), "error")
        .when(is_queue, "queue")
        .when(is_series, "series")
        .when(F.startswith(text, F.lit("[sync]")), "sync")
        .when(F.startswith(text, F.lit("[t]")), "timing")
        .when(text.rlike(fixed.LOG_STEP), "step")
        .when(F.startswith(text, F.lit("Regenerating:")), "chapter")
        .when(text.rlike(fixed.LOG_WARN), "warn")
        .when(text.rlike(fixed.LOG_ERROR) | text.rlike(fixed.LOG_ERROR_ANYWHERE), "error")
        .when(F.startswith(trimmed, F.lit("\t")), "chapter")
        .otherwise("info")
    )
    shown = (
        F.when(is_queue, F.coalesce(F.nullif(queue, F.lit("")), text))
        .when(is_series, series(4))
        .when(F.startswith(text, F.lit("[sync]")), after("[sync]"))
        .when(F.startswith(text, F.lit("[t]")), after("[t]"))
        .when(F.startswith(text, F.lit("Regenerating:")), after("Regenerating:"))
        .otherwise(text)
    )
    number = lambda i: F.when(is_series, series(i).cast("bigint"))
    return F.struct(
        kind.alias("kind"),
        shown.alias("text"),
        F.when(is_series, F.when(series(3) == "Scraping", "scrape").otherwise("generate")).alias("phase"),
        number(1).alias("idx"),
        number(2).alias("total"),
    )


def parse_log(log: DataFrame) -> DataFrame:
    """(seq, kind, text, phase, idx, total) of the lines that are not blank."""
    return log.where(F.col("line").rlike(r"(?U)\S")).select("seq", parse_line(F.col("line")).alias("i")).select("seq", "i.*")


def number_items(items: DataFrame, block: int = 65536) -> DataFrame:
    """Dense position of each item, from counts per block of ``seq``."""
    return row_number_by(items, [], [F.asc("seq")], [F.expr(f"seq div {block * 4096}"), F.expr(f"seq div {block}")], "pos")


def mark_finished(items: DataFrame, block: int = 65536, lookback: int = fixed.LOG_LOOKBACK) -> DataFrame:
    """Positions of chapter items that a later 'Converted' step marks as finished.

    The step marks the nearest chapter within ``lookback`` items, unless a series marker is
    nearer. Blocks of positions overlap by ``lookback`` items, so each is a window of its own.
    """
    home = F.expr(f"pos div {block}")
    late = F.expr(f"pos % {block}") >= block - lookback
    spread = items.select(
        "pos", "kind", "text", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("__b"), home.alias("__home")
    )
    w = Window.partitionBy("__b").orderBy("pos").rowsBetween(-lookback, -1)
    anchor = F.when(F.col("kind").isin("chapter", "series"), F.struct("pos", "kind"))
    seen = spread.withColumn("__a", F.last(anchor, ignorenulls=True).over(w))
    step = (F.col("kind") == "step") & F.startswith("text", F.lit("Converted")) & (F.col("__b") == F.col("__home"))
    return seen.where(step & (F.col("__a.kind") == "chapter")).select(F.col("__a.pos").alias("pos")).distinct()


def mark_empty(items: DataFrame, block: int = 65536) -> DataFrame:
    """Positions of series items with only timing or info items before the next series, queue or sync item."""
    kept = items.where(~F.col("kind").isin("timing", "info")).select("pos", "kind", F.expr(f"pos div {block}").alias("__b"))
    w = Window.partitionBy("__b").orderBy("pos")
    near = kept.withColumn("__next", F.lead("kind").over(w))
    firsts = kept.groupBy("__b").agg(F.min_by("kind", "pos").alias("__first"))
    following = _next_block(firsts)
    joined = near.join(following, "__b", "left").withColumn("__next", F.coalesce("__next", "__carry"))
    return joined.where((F.col("kind") == "series") & F.col("__next").isin("series", "queue", "sync")).select("pos")


def _next_block(firsts: DataFrame, group: int = 4096) -> DataFrame:
    """(__b, __carry): the first kind of the next block that has any, in two levels, so that no task sees all blocks."""
    cut = firsts.withColumn("__g", F.expr(f"__b div {group}"))
    inside = cut.withColumn("__carry", F.lead("__first").over(Window.partitionBy("__g").orderBy("__b")))
    heads = cut.groupBy("__g").agg(F.min_by("__first", "__b").alias("__head"))
    beyond = heads.select("__g", F.lead("__head").over(Window.orderBy("__g")).alias("__far"))
    out = inside.join(beyond, "__g", "left")
    return out.select("__b", F.coalesce("__carry", "__far").alias("__carry"))


def annotate(items: DataFrame, block: int = 65536) -> DataFrame:
    """Items with ``ok`` (finished chapter) and ``empty`` (series that brought nothing)."""
    ok = mark_finished(items, block).withColumn("ok", F.lit(True))
    empty = mark_empty(items, block).withColumn("empty", F.lit(True))
    rows = items.join(ok, "pos", "left").join(empty, "pos", "left")
    return rows.withColumns({"ok": F.coalesce("ok", F.lit(False)), "empty": F.coalesce("empty", F.lit(False))})


def compact(annotated: DataFrame) -> DataFrame:
    noise = F.col("kind").isin("step", "timing", "info") | ((F.col("kind") == "series") & F.col("empty"))
    return annotated.where(~noise)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).cast("bigint")


def _last(value: Column, when: Column) -> Column:
    return F.max(F.when(when, F.struct(F.col("seq").alias("seq"), value.alias("v"))))


def fold_progress(events: DataFrame, keys: list[str] = ["job_id"]) -> DataFrame:  # noqa: B006
    """Progress per job: the same plan for a batch and for a stream.

    Each field is the last event of its kind, with a series start clearing chapter and percent.
    Maxima combine before the shuffle, so one huge job is no hot key, and events may arrive in
    any order.
    """
    t = F.col("type")
    pct = (
        F.when(t == "chapter_started", F.lit(0))
        .when((t == "chunk_progress") & (F.col("chars_total") > 0), F.expr("chars_done * 100 div case when chars_total > 0 then chars_total end"))
        .when(t == "chapter_done", F.lit(100))
        .cast("bigint")
    )
    folded = events.groupBy(*keys).agg(
        _last(F.col("message"), t == "phase_started").alias("__phase"),
        _last(F.struct("series", "index", "total"), t == "series_started").alias("__series"),
        _last(F.struct("chapter", "raw_path"), t == "chapter_started").alias("__chapter"),
        _last(pct, pct.isNotNull()).alias("__pct"),
        F.max("seq").alias("last_seq"),
    )
    reset = F.coalesce(F.col("__series.seq"), F.lit(-1))
    return folded.select(
        *keys,
        F.col("__phase.v").alias("phase"),
        F.col("__series.v.series").alias("series"),
        F.col("__series.v.index").alias("series_idx"),
        F.col("__series.v.total").alias("series_total"),
        F.when(F.col("__chapter.seq") > reset, F.col("__chapter.v.chapter")).alias("chapter"),
        F.col("__chapter.v.raw_path").alias("raw_path"),
        F.when(F.col("__pct.seq") > reset, F.col("__pct.v")).alias("pct"),
        "last_seq",
    )


def latest_event(events: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(F.struct(*fields), "seq").alias("e")).select(*keys, "e.*")


def lifecycle(events: DataFrame) -> DataFrame:
    """Start, end, duration and final status per job."""
    end = {"job_finished": "done", "job_failed": "failed", "job_cancelled": "cancelled"}
    t = F.col("type")
    status = F.create_map(*[F.lit(x) for kv in end.items() for x in kv])
    folded = events.groupBy("job_id").agg(
        F.min(F.when(t == "job_started", F.col("ts"))).alias("started_at"),
        _last(F.struct("ts", "type", "error"), t.isin(list(end))).alias("__end"),
    )
    return folded.select(
        "job_id",
        "started_at",
        F.col("__end.v.ts").alias("finished_at"),
        F.coalesce(F.element_at(status, F.col("__end.v.type")), F.when(F.col("started_at").isNull(), "queued"), F.lit("running")).alias("status"),
        F.col("__end.v.error").alias("error"),
        (F.unix_micros(F.col("__end.v.ts").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))).alias("took_us"),
    )


def accepted_requests(jobs: DataFrame, parts: int | None = None) -> DataFrame:
    """Requests that start a job: a request is dropped while an accepted one with its key is active.

    An accepted job is active on [created, finished), one without an end for ever. From each request the next acceptable one
    of its key is the first created at or after its end, found over ranges of time; the accepted ones are those reached
    from the key's first request. A key with a third of the requests is spread out in both steps. Columns: id, key, created, finished.
    """
    base = jobs.select("key", "id", "created", "finished")
    # after its end; a job that ends as it starts is followed by the next id of that moment
    ends_later = F.when(F.col("finished") > F.col("created"), F.lit(-(1 << 62))).otherwise(F.col("id"))
    probes = base.where("finished is not null").select("key", F.col("finished").alias("at"), ends_later.alias("tie"), F.col("id").alias("from_id"))
    targets = base.select("key", F.col("created").alias("at"), F.col("id").alias("tie"), F.col("id").alias("next_id"))
    links = next_after(probes, targets, ["key"], "at", "tie", "next_id", parts)
    starts = base.groupBy("key").agg(F.min_by("id", F.struct("created", "id")).alias("from_id"))
    walked = follow_links(links.select("key", "from_id", "next_id"), starts, ["key"], "from_id", "next_id")
    return walked.select("key", F.col("from_id").alias("id"))


def new_finished(history: DataFrame, seen: DataFrame) -> DataFrame:
    return history.join(seen.select("id"), "id", "left_anti")


def job_label(kind: Column, target: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in fixed.JOB_LABELS.items() for x in kv])
    base = F.coalesce(F.get(F.array(F.element_at(labels, kind)), F.lit(0)), kind)
    return F.when(F.coalesce(target, F.lit("")) != "", F.concat(base, F.lit(" — "), target)).otherwise(base)


def run_state(current_type: Column, phase: Column, last_status: Column) -> Column:
    """State badge: from the running job when there is one, else from the last finished job."""
    return (
        F.when(current_type.isin(fixed.SCRAPE_JOBS), "scraping")
        .when((current_type == "full_pipeline") & (phase == "scrape"), "scraping")
        .when(current_type.isNotNull(), "generating")
        .when(last_status == "done", "finished")
        .when(last_status == "failed", "error")
        .when(last_status == "cancelled", "cancelled")
        .otherwise("idle")
    )


def throughput(timing: DataFrame, keys: list[str]) -> DataFrame:
    return timing.groupBy(*keys).agg(
        F.sum("wall_s").alias("wall_s"),
        F.sum("audio_s").alias("audio_s"),
        (F.sum("wall_s") / F.nullif(F.sum("audio_s"), F.lit(0.0))).alias("ratio"),
    )
