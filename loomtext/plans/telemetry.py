"""Job events and logs as batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import telemetry as M
from ..session import cut_lineage
from .registry import query


_CLEAN = "regexp_replace(line, chr(27) || '\\[[0-9;]*m', '', 'g')"
_SERIES = "regexp_extract(tx, '^\\[([0-9]+)/([0-9]+)\\]\\s+(Scraping|Generating)\\s+(.+)$', {})"
ITEMS = f"""c as (select seq, rtrim({_CLEAN}) as ln, trim(replace({_CLEAN}, chr(9), '')) as tx from V_log),
    items as (select seq, row_number() over (order by seq) as pos, ln, tx,
      case when starts_with(tx, '[queue]') and regexp_matches(tx, '(?i)^\\[queue\\]\\s*failed\\b') then 'error' when starts_with(tx, '[queue]') then 'queue'
           when {_SERIES.format(1)} <> '' then 'series' when starts_with(tx, '[sync]') then 'sync' when starts_with(tx, '[t]') then 'timing'
           when tx in ('Merged!', 'Saved!', 'Converted to MP3!') then 'step' when starts_with(tx, 'Warning:') then 'warn' when starts_with(tx, 'Error on') then 'error'
           when starts_with(ln, chr(9)) then 'chapter' else 'info' end as kind from c where tx <> '')"""


def lines(fx):
    return M.split_log(fx.V_log, keep_indent=True).select("seq", "line")


@query("FN17_strip_colours", f"select seq, trim({_CLEAN}, chr(9) || ' ') as line from V_log")
def _(fx):
    return M.split_log(fx.V_log).select("seq", "line")


@query("FN18_line_kinds", f"with {ITEMS} select seq, kind from items")
def _(fx):
    return M.parse_log(lines(fx)).select("seq", "kind")


@query(
    "FN19_series_markers",
    f"with {ITEMS} select seq, cast({_SERIES.format(1)} as bigint) as idx, cast({_SERIES.format(2)} as bigint) as total, case when {_SERIES.format(3)} = 'Scraping' then 'scrape' else 'generate' end as phase, {_SERIES.format(4)} as text from items where kind = 'series'",
)
def _(fx):
    return M.parse_log(lines(fx)).where("kind = 'series'").select("seq", "idx", "total", "phase", "text")


# brute force: every step looks back row by row, every series marker looks ahead
_OK = """ok as (select distinct ch.pos from items st join items ch on ch.pos < st.pos and ch.pos >= st.pos - 30 and ch.kind = 'chapter' where st.kind = 'step' and starts_with(st.tx, 'Converted')
    and not exists (select 1 from items o where o.pos > ch.pos and o.pos < st.pos and o.kind in ('chapter', 'series')))"""
_EMPTY = "em as (select pos from (select pos, kind, lead(kind) over (order by pos) as nxt from items where kind not in ('timing', 'info')) where kind = 'series' and nxt in ('series', 'queue', 'sync'))"


def items(fx, block):
    return M.number_items(M.parse_log(lines(fx)), block)




@query("WN5_finished_chapters", f"with {ITEMS}, {_OK} select items.seq from items join ok on ok.pos - 0 = items.pos")
def _(fx):
    rows = items(fx, 65536)
    return M.mark_finished(rows).join(rows, "pos").select("seq")


@query("WN5_finished_chapters_small_blocks", f"with {ITEMS}, {_OK} select items.seq from items join ok on ok.pos - 0 = items.pos")
def _(fx):
    """Blocks barely longer than the look-back, so that most marks cross a block edge."""
    rows = items(fx, 32)
    return M.mark_finished(rows, 32).join(rows, "pos").select("seq")


@query("WN4_empty_series", f"with {ITEMS}, {_EMPTY} select items.seq from items join em on em.pos = items.pos")
def _(fx):
    rows = items(fx, 65536)
    return M.mark_empty(rows).join(rows, "pos").select("seq")


@query("WN4_empty_series_small_blocks", f"with {ITEMS}, {_EMPTY} select items.seq from items join em on em.pos = items.pos")
def _(fx):
    rows = items(fx, 2)
    return M.mark_empty(rows, 2).join(rows, "pos").select("seq")


@query("PRJ13_compact_log", f"with {ITEMS}, {_OK}, {_EMPTY} select items.seq, kind, ok.pos is not null as ok from items left join ok on ok.pos = items.pos left join em on em.pos = items.pos where kind not in ('step', 'timing', 'info') and not (kind = 'series' and em.pos is not null)")
def _(fx):
    return M.compact(M.annotate(cut_lineage(items(fx, 65536)))).select("seq", "kind", "ok")


@query("PRJ12_percent", "select seq, case when chars_total > 0 then chars_done * 100 // chars_total end as pct from V_job_events")
def _(fx):
    return fx.V_job_events.select("seq", M.percent(F.col("chars_done"), F.col("chars_total")).alias("pct"))


FOLD = """with e as (select * from V_job_events),
    s as (select job_id, max(seq) filter (where type = 'series_started') as reset from e group by job_id),
    p as (select job_id, seq, case when type = 'chapter_started' then 0 when type = 'chapter_done' then 100 when type = 'chunk_progress' and chars_total > 0 then chars_done * 100 // chars_total end as pct from e)
    select e.job_id, arg_max(message, seq) filter (where type = 'phase_started') as phase, arg_max(series, seq) filter (where type = 'series_started') as series,
      arg_max(chapter, seq) filter (where type = 'chapter_started' and seq > coalesce(reset, -1)) as chapter,
      arg_max(raw_path, seq) filter (where type = 'chapter_started') as raw_path,
      (select cast(arg_max(pct, p.seq) as bigint) from p where p.job_id = e.job_id and pct is not null and p.seq > coalesce(max(s.reset), -1)) as pct, max(e.seq) as last_seq
    from e join s on s.job_id = e.job_id group by e.job_id"""
FOLD_COLUMNS = ["job_id", "phase", "series", "chapter", "raw_path", "pct", "last_seq"]


@query("STR1_progress_batch", FOLD)
def _(fx):
    return M.fold_progress(fx.V_job_events).select(*FOLD_COLUMNS)


@query("WN11_latest_event", "select job_id, arg_max(type, seq) as type, arg_max(chapter, seq) as chapter, max(seq) as seq from V_job_events group by job_id")
def _(fx):
    return M.latest_event(fx.V_job_events, ["job_id"], ["type", "chapter", "seq"])


@query("WN11_latest_event_per_chapter", "select raw_path, arg_max(type, seq) as type, max(seq) as seq from V_job_events group by raw_path")
def _(fx):
    return M.latest_event(fx.V_job_events, ["raw_path"], ["type", "seq"])


ACCEPTED = """with recursive j as (select id, key, created, finished from V_work), w(key, id, finished) as (
          select key, arg_min(id, id), arg_min(finished, id) from j group by key
          union all select w.key, n.id, n.finished from w, lateral (select id, finished from j where j.key = w.key and j.created >= w.finished and j.id > w.id order by id limit 1) n)
        select key, id from w"""


@query("STR2_accepted_requests", ACCEPTED)
def _(fx):
    return M.accepted_requests(fx.V_work)


@query("STR2_accepted_requests_small_buckets", ACCEPTED)
def _(fx):
    """Cut into many more parts than there are cores, so that most answers come over the edge of a part."""
    return M.accepted_requests(fx.V_work, parts=97)


LIFE = """select event_id as seq, cast(ts as timestamp) as ts, cast(user_id as string) as job_id, case event_type when 'signup' then 'job_started' when 'purchase' then 'job_finished' when 'error' then 'job_failed' when 'click' then 'job_cancelled' else 'chunk_progress' end as type,
    case when event_type = 'error' then concat('bad ', cast(event_id as string)) end as error from events"""


@query(
    "STR5_job_lifecycle",
    f"""with e as ({LIFE}), g as (select job_id, min(ts) filter (where type = 'job_started') as started, arg_max(struct_pack(ts := ts, type := type, error := error), seq) filter (where type in ('job_finished', 'job_failed', 'job_cancelled')) as e from e group by job_id)
        select job_id, case e.type when 'job_finished' then 'done' when 'job_failed' then 'failed' when 'job_cancelled' then 'cancelled' else case when started is null then 'queued' else 'running' end end as status, e.error as error, epoch_us(e.ts) - epoch_us(started) as took_us from g""",
)
def _(fx):
    return M.lifecycle(fx.sql(LIFE)).select("job_id", "status", "error", "took_us")


@query("SET5_newly_finished", "select id, status from V_jobs where event_type in ('purchase', 'error') and user_id not in (select doc_id from labels)")
def _(fx):
    history = fx.V_jobs.where("event_type in ('purchase', 'error')")
    seen = history.join(fx.labels.select(F.col("doc_id").alias("user_id")), "user_id", "left_semi")
    return M.new_finished(history, seen).select("id", "status")


_LABELS = " ".join(f"when '{k}' then '{v}'" for k, v in fixed.JOB_LABELS.items())


@query("FN23_job_label", f"select id, case job_type {_LABELS} end || case when k % 3 <> 0 then ' — ' || 's' || k else '' end as label from V_jobs")
def _(fx):
    target = F.when(F.col("k") % 3 != 0, F.concat(F.lit("s"), F.col("k").cast("string")))
    return fx.V_jobs.select("id", M.job_label(F.col("job_type"), target).alias("label"))


@query(
    "FN23_run_state",
    """with last as (select user_id, arg_max(status, id) as status from V_jobs where status <> 'running' group by user_id), cur as (select user_id, arg_max(job_type, id) as job_type, arg_max(k, id) as k from V_jobs where status = 'running' and k >= 50 group by user_id)
       select l.user_id, case when c.job_type in ('scrape_all', 'scrape_series', 'rescrape_chapter') or (c.job_type = 'full_pipeline' and c.k % 2 = 0) then 'scraping' when c.job_type is not null then 'generating'
         when l.status = 'done' then 'finished' when l.status = 'failed' then 'error' when l.status = 'cancelled' then 'cancelled' else 'idle' end as state from last l left join cur c on c.user_id = l.user_id""",
)
def _(fx):
    last = fx.V_jobs.where("status <> 'running'").groupBy("user_id").agg(F.max_by("status", "id").alias("status"))
    cur = fx.V_jobs.where("status = 'running' and k >= 50").groupBy("user_id").agg(F.max_by("job_type", "id").alias("job_type"), F.max_by("k", "id").alias("k"))
    phase = F.when(F.col("k") % 2 == 0, "scrape").otherwise("audio")
    return last.join(cur, "user_id", "left").select("user_id", M.run_state(F.col("job_type"), phase, F.col("status")).alias("state"))


@query("AG8_throughput", "select voice, round(sum(wall_s), 4) as wall_s, round(sum(audio_s), 4) as audio_s, round(sum(wall_s) / nullif(sum(audio_s), 0), 6) as ratio from V_timing group by voice")
def _(fx):
    rows = M.throughput(fx.V_timing, ["voice"])
    return rows.select("voice", F.round("wall_s", 4).alias("wall_s"), F.round("audio_s", 4).alias("audio_s"), F.round("ratio", 6).alias("ratio"))


@query("STR4_log_annotated_batch", f"with {ITEMS}, {_OK}, {_EMPTY} select items.seq, kind, ok.pos is not null as ok, em.pos is not null as empty from items left join ok on ok.pos = items.pos left join em on em.pos = items.pos")
def _(fx):
    return M.annotate(cut_lineage(items(fx, 65536))).select("seq", "kind", "ok", "empty")
