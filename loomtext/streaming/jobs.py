"""Streams over job events, requests, texts and logs.

Each function that runs a stream takes ``out`` and ``checkpoint``, two folders that belong together: called again with both, it goes on where it
stopped, reads new files only, and returns the result over all it has seen. Without them it starts anew in fresh folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.base import posexplode_rows
from ..functions.text import clean_for_speech
from ..operators.segment import pack
from ..operators.telemetry import annotate, fold_progress, number_items, parse_log, split_log
from ..session import cut_lineage, work_path
from .runs import newest_version, read_batches, run_to_end


def progress(events: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Progress per job from a stream of events: the batch plan, kept up to date. State: a row for each job."""
    spark, out = events.sparkSession, out or work_path(events.sparkSession, "progress")
    folded = fold_progress(events)
    run_to_end(folded, out, "update", checkpoint=checkpoint)
    return newest_version(read_batches(spark, out, folded.schema), ["job_id"])


def first_requests(requests: DataFrame, delay: str) -> DataFrame:
    """Requests whose key was not seen within the watermark: a stream to go on from, which is not run yet.

    Which requests start a job while others are active, ``requests.accepted_stream`` says.
    """
    return requests.withWatermark("created", delay).dropDuplicatesWithinWatermark(["key"])


def notify_once(finished: DataFrame, delay: str | None = None, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """One row per finished job, however often its end is reported.

    With ``delay`` a job is forgotten that long after its end (by ``ts``), which bounds the state; a report that comes
    later still is told apart when the rows are read.
    """
    spark, out = finished.sparkSession, out or work_path(finished.sparkSession, "notified")
    if delay is None:
        once = finished.select("job_id").dropDuplicates(["job_id"])
    else:
        once = finished.select("job_id", "ts").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id"])
    run_to_end(once, out, checkpoint=checkpoint)
    return read_batches(spark, out, once.schema).select("job_id").distinct()


def windowed_counts(
    events: DataFrame, delay: str, length: str, slide: str | None = None, out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Counts per type and window; rows later than the delay are dropped."""
    spark, out = events.sparkSession, out or work_path(events.sparkSession, "windows")
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = (
        events.withWatermark("ts", delay)
        .groupBy(span, "type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "type", "n")
    )
    run_to_end(counted, out, "update", checkpoint=checkpoint)
    return newest_version(read_batches(spark, out, counted.schema), ["start", "type"])


def all_sessions(events: DataFrame, delay: str, gap: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Sessions per job with ``open``: those the watermark has closed, and those it has not, read from the state.

    An open session grows with the next call's events, or is closed by them.
    """
    spark, checkpoint = events.sparkSession, checkpoint or work_path(events.sparkSession, "stream")
    closed = closed_sessions(events, delay, gap, out, checkpoint).withColumn("open", F.lit(False))
    state = spark.read.format("statestore").option("path", checkpoint).load()
    span = F.col("value.session_window")
    held = state.select(F.col("value.job_id").alias("job_id"), span["start"].alias("start"), span["end"].alias("end"), F.col("value.count").alias("n"))
    # a later call would change the state under a plan that still reads it
    return closed.unionByName(cut_lineage(held).withColumn("open", F.lit(True)))


def closed_sessions(events: DataFrame, delay: str, gap: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Sessions per job that the watermark has closed; those still open stay in the state for the next call."""
    spark, out = events.sparkSession, out or work_path(events.sparkSession, "sessions")
    sessions = (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("s"), "job_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )
    run_to_end(sessions, out, checkpoint=checkpoint)
    return read_batches(spark, out, sessions.schema).drop("batch")


def ingest_texts(texts: DataFrame, limit: int = fixed.CHUNK_CHARS_LARGE, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """New texts cleaned, packed and appended; files seen before are not read again."""
    spark = texts.sparkSession
    out = out or work_path(spark, "chunks")
    cleaned = texts.select("doc_id", "source", clean_for_speech("text").alias("t"))
    chunks = posexplode_rows(cleaned, pack("t", limit), "chunk_idx", "chunk", "doc_id", "source")
    run_to_end(chunks, out, checkpoint=checkpoint)
    return read_batches(spark, out, chunks.schema).drop("batch")


_TAIL = ["pos", "seq", "kind", "text"]


def annotate_log(log: DataFrame, block: int = 65536, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Classified log items with their marks, where marks may reach back into earlier batches.

    Between batches a tail is kept: the newest items within the look-back and the newest item that
    is neither timing nor info. It has at most lookback + 1 rows. A batch is marked together with
    the tail before it. Batches have to arrive in order of ``seq``.
    """
    spark = log.sparkSession
    out = out or work_path(spark, "log")
    tails = f"{out.rstrip('/')}-tail"
    tail_schema = "pos bigint, seq bigint, kind string, text string"

    def each(batch: DataFrame, batch_id: int) -> DataFrame:
        before = spark.read.schema(tail_schema).parquet(f"{tails}/{batch_id - 1}") if batch_id else spark.createDataFrame([], tail_schema)
        at = before.agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]
        items = number_items(parse_log(split_log(batch, keep_indent=True).select("seq", "line")), block)
        items = cut_lineage(items.withColumn("pos", F.col("pos") + at))
        both = before.unionByName(items.select(*_TAIL))
        near = both.orderBy(F.desc("pos")).limit(fixed.LOG_LOOKBACK)
        kept = both.where(~F.col("kind").isin("timing", "info")).orderBy(F.desc("pos")).limit(1)
        near.unionByName(kept).distinct().coalesce(1).write.mode("overwrite").parquet(f"{tails}/{batch_id}")
        return annotate(both, block).select("seq", "kind", "text", "ok", "empty")

    run_to_end(log, out, each=each, checkpoint=checkpoint)
    rows = read_batches(spark, out, T.StructType.fromDDL("seq bigint, kind string, text string, ok boolean, empty boolean"))
    # an item of the tail is written again with the marks the next batch gave it
    return rows.groupBy("seq").agg(
        F.first("kind").alias("kind"), F.first("text").alias("text"), F.bool_or("ok").alias("ok"), F.bool_or("empty").alias("empty")
    )
