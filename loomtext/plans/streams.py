"""Streams over the event, text and log files, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..streaming import jobs as J
from ..streaming.requests import accepted_stream, request_events
from ..streaming.runs import event_time, read_batches, read_files, run_to_end
from ..session import work_path
from .registry import query
from .segment import sql_pack
from .telemetry import ACCEPTED, FOLD, FOLD_COLUMNS, ITEMS, _EMPTY, _OK
from .text import CLEANED


def streamed(fx, name):
    """A view over a table that arrives as a stream of files."""
    from .fixtures import Fixtures

    table = "documents" if name == "documents" else "events"
    stream = read_files(fx.spark, fx.dir, f"{table}.parquet", getattr(fx, table).schema)
    over = Fixtures(fx.spark, fx.dir)
    over._made[table] = stream
    return getattr(over, name)


@query("STR1_progress_stream", FOLD)
def _(fx):
    return J.progress(streamed(fx, "V_job_events")).select(*FOLD_COLUMNS)


@query("STR2_first_requests_stream")
def _(fx):
    jobs = event_time(streamed(fx, "V_jobs"), "created").select("id", "key", "created")
    out = work_path(fx.spark, "requests")
    first = J.first_requests(jobs, "30 minutes")
    run_to_end(first, out)
    return read_batches(fx.spark, out, first.schema).select("key").distinct()


@query("STR2_accepted_requests_stream", ACCEPTED)
def _(fx):
    accepted = accepted_stream(request_events(streamed(fx, "V_work")))
    return accepted.select("key", "id")


@query(
    "STR3_ingest_texts",
    f"""with {CLEANED}, e as (select doc_id, source, {sql_pack('text', fixed.CHUNK_CHARS_LARGE)} as cs from d)
        select doc_id, source, unnest(range(len(cs))) as chunk_idx, unnest(cs) as chunk from e""",
)
def _(fx):
    chunks = J.ingest_texts(streamed(fx, "documents"))
    return chunks.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint"))


@query("STR4_log_stream", f"with {ITEMS}, {_OK}, {_EMPTY} select items.seq, kind, ok.pos is not null as ok, em.pos is not null as empty from items left join ok on ok.pos = items.pos left join em on em.pos = items.pos")
def _(fx):
    return J.annotate_log(streamed(fx, "V_log")).select("seq", "kind", "ok", "empty")


@query("STR6_notify_once", "select distinct cast(user_id as varchar) as job_id from events where event_type in ('purchase', 'error')")
def _(fx):
    ends = event_time(streamed(fx, "V_job_events")).where("type in ('chapter_done', 'chapter_failed')")
    return J.notify_once(ends, delay="1 hour")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("STR7_tumbling_counts", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, type, count(*) as n from V_job_events group by all")
def _(fx):
    counts = J.windowed_counts(event_time(streamed(fx, "V_job_events")), "10 minutes", "1 hour")
    return counts.select(_stamp("start"), "type", "n")


@query(
    "STR7_sliding_counts",
    "select strftime(time_bucket(interval 1 hour, ts) - to_hours(h), '%Y-%m-%d %H:%M:%S') as start, type, count(*) as n from V_job_events, (select unnest(range(6)) as h) group by all",
)
def _(fx):
    counts = J.windowed_counts(event_time(streamed(fx, "V_job_events")), "10 minutes", "6 hours", "1 hour")
    return counts.select(_stamp("start"), "type", "n")


@query(
    "STR7_sessions",
    """with e as (select job_id, ts, case when ts - lag(ts) over (partition by job_id order by ts) < interval 2 hour then 0 else 1 end as fresh from V_job_events),
        s as (select job_id, ts, sum(fresh) over (partition by job_id order by ts rows unbounded preceding) as no from e),
        g as (select job_id, no, min(ts) as b, max(ts) + interval 2 hour as f, count(*) as n from s group by job_id, no)
        select job_id, strftime(b, '%Y-%m-%d %H:%M:%S') as start, n, f > (select date_trunc('milliseconds', max(ts)) - interval 10 minute from events) as open from g""",
)
def _(fx):
    sessions = J.all_sessions(event_time(streamed(fx, "V_job_events")), "10 minutes", "2 hours")
    return sessions.select("job_id", _stamp("start"), "n", "open")
