"""State tables: look-ups, reports, work lists and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import ranking as R
from ..operators.ranking import in_order
from ..operators import state as S
from ..schemas import CHAPTERS
from ..sources.tables import conform
from .registry import query

NOW = "timestamp '2024-03-02 00:00:00'"
_SHOW = "id, series_id, title, status"
_STATUS_SQL = ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in fixed.STATUSES)


def now():
    return F.expr(NOW)


def ts(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_ts(name):
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') as {name}"


@query("SRC5_state_tables", f"select id, series_id, status, retry_count, {sql_ts('updated_at')}, cast(null as varchar) as checked_at, duration_s from V_chapters")
def _(fx):
    rows = conform(fx.V_chapters, CHAPTERS)
    return rows.select("id", "series_id", "status", "retry_count", ts("updated_at"), ts("checked_at"), "duration_s")


@query("PRJ1_chapter_by_id", f"select {_SHOW} from V_chapters where id = (select max(doc_id) // 2 from documents)")
def _(fx):
    wanted = F.lit(fx.documents.agg(F.expr("max(doc_id) div 2")).first()[0])
    return S.chapter_by_id(fx.V_chapters, wanted).select("id", "series_id", "title", "status")


@query("PRJ2_chapters_of_series", "select id, raw_path, status, row_number() over (order by raw_path) as rank from V_chapters where series_id = 7")
def _(fx):
    return in_order(S.chapters_of(fx.V_chapters, F.lit(7)).select("id", "raw_path", "status"))


@query("PRJ2_chapters_of_series_by_status", "select id, raw_path, status, row_number() over (order by raw_path) as rank from V_chapters where series_id = 7 and status = 'pending'")
def _(fx):
    return in_order(S.chapters_of(fx.V_chapters, F.lit(7), "pending").select("id", "raw_path", "status"))


@query("PRJ3_enabled_series", "select id, name from V_series where coalesce(enabled, true)")
def _(fx):
    return S.enabled(fx.V_series).select("id", "name")


@query("PRJ8_null_defaults", "select id, coalesce(error, '') as error, coalesce(source_url, '') as source_url, coalesce(output_path, '') as output_path from V_chapters")
def _(fx):
    return S.with_defaults(fx.V_chapters, ["error", "source_url", "output_path"]).select("id", "error", "source_url", "output_path")


@query("PRJ9_search", "select id, title, error from V_chapters where contains(lower(title), 'src1') or contains(lower(coalesce(error, '')), 'src1') or contains(lower(status), 'src1')")
def _(fx):
    return S.search(fx.V_chapters, ["title", "error", "status"], "SRC1").select("id", "title", "error")


@query("PRJ11_overlay_settings", "select id, series, 'large' as engine, 5 as batch_size, true as verbose from V_config")
def _(fx):
    rows = S.overlay_settings(fx.V_config, {"batch_size": 5, "verbose": True})
    return rows.select("id", "series", "engine", "batch_size", "verbose")


@query("JN1_failed_with_series", "select c.id, s.name as series_name, c.error from V_chapters c join V_series s on s.id = c.series_id where c.status = 'failed'")
def _(fx):
    return S.failed(fx.V_chapters, fx.V_series).select("id", "series_name", "error")


@query("OR4_newest_failures", f"select c.id, {sql_ts('c.updated_at').replace('as c.', 'as ')}, row_number() over (order by c.updated_at desc, c.id) as rank from V_chapters c where status = 'failed'")
def _(fx):
    return in_order(S.failed(fx.V_chapters, fx.V_series).select("id", ts("updated_at")))


_REGISTERED = "select id, name, case when id % 3 = 0 then '' when id % 3 = 1 then concat('state', cast(id as string)) end as narrator from V_series where enabled is not null"


@query(
    "JN2_dashboard",
    f"""with reg as ({_REGISTERED}), n as (select series_id, {_STATUS_SQL} from V_chapters group by series_id)
        select s.name, coalesce(pending, 0) as pending, coalesce(processing, 0) as processing, coalesce(done, 0) as done, coalesce(failed, 0) as failed,
          coalesce(nullif(reg.narrator, ''), s.narrator, '') as narrator, coalesce(s.url, '') as url
        from V_series s left join reg on reg.name = s.name left join n on n.series_id = reg.id where coalesce(s.enabled, true)""",
)
def _(fx):
    return S.dashboard(fx.V_series, fx.V_chapters, fx.sql(_REGISTERED))


@query("AG1_status_per_series", f"select series_id, {_STATUS_SQL} from V_chapters group by series_id")
def _(fx):
    return S.status_counts(fx.V_chapters, ["series_id"])


@query("AG1_status_per_series_large", f"select series_id, {_STATUS_SQL} from V_state_big group by series_id")
def _(fx):
    return S.status_counts(fx.V_state_big, ["series_id"])


@query("AG2_status_totals", "select status, count(*) as n from V_state_big group by status")
def _(fx):
    return S.status_totals(fx.V_state_big)


_STATS = """select count(*) as done_count, round(coalesce(sum(duration_s), 0) / 3600, 4) as tracked_hours,
    count(*) filter (where updated_at >= {now} - interval 7 day) as done_7d, count(*) filter (where updated_at >= {now} - interval 30 day) as done_30d from {table} where status = 'done'"""


@query("AG3_done_stats", _STATS.format(now=NOW, table="V_chapters"))
def _(fx):
    return S.done_stats(fx.V_chapters, now()).withColumn("tracked_hours", F.round("tracked_hours", 4))


@query("AG3_done_stats_large", _STATS.format(now="timestamp '1999-12-01'", table="V_state_big"))
def _(fx):
    return S.done_stats(fx.V_state_big, F.expr("timestamp '1999-12-01'")).withColumn("tracked_hours", F.round("tracked_hours", 4))


_ROLES = """select series, narrator as voice, 'narrator' as role from V_config union all select series, map_user, 'mapping' from V_config
    union select series, map_assistant, 'mapping' from V_config union all select series, system_voice, 'system' from V_config"""


def config_maps(fx):
    return fx.V_config.withColumn("mappings", F.create_map(F.lit("user"), "map_user", F.lit("assistant"), "map_assistant", F.lit("guest"), "map_user"))


@query("SET1_voice_roles", f"select distinct series, voice, role from ({_ROLES})")
def _(fx):
    return S.voice_roles(config_maps(fx))


@query("AG7_where_used", f"select v.voice_name as voice, case when r.voice is not null then series || ' (' || role || ')' end as used_by from V_voices v left join (select distinct series, voice, role from ({_ROLES})) r on r.voice = v.voice_name")
def _(fx):
    return S.where_used(fx.V_voices, config_maps(fx))


@query("OR1_work_list", "select id, coalesce(chapter_index, 999999) as idx, published_date, row_number() over (order by coalesce(chapter_index, 999999), published_date, raw_path) as rank from V_chapters where status in ('pending', 'failed')")
def _(fx):
    rows = S.work_list(fx.V_chapters)
    return in_order(rows.select("id", F.coalesce("chapter_index", F.lit(fixed.MISSING_INDEX)).alias("idx"), "published_date"))


_FIRST_25 = "(select id, row_number() over (order by updated_at desc, id) as rn, count(*) over () as total from V_chapters)"


def _page_sql(index, size):
    return f"select id from {_FIRST_25} where rn > least({index}, greatest(cast(ceil(total / {size}.0) as bigint) - 1, 0)) * {size} and rn <= (least({index}, greatest(cast(ceil(total / {size}.0) as bigint) - 1, 0)) + 1) * {size}"


def _page(fx, index, size):
    day = -F.unix_seconds(F.col("updated_at").cast("timestamp"))
    return R.page(fx.V_chapters.select("id", "updated_at"), [F.desc("updated_at"), F.asc("id")], [F.expr("-unix_date(cast(updated_at as date))"), day, F.expr("id div 65536")], index, size).select("id")


@query("OR5_page", _page_sql(3, 25))
def _(fx):
    return _page(fx, 3, 25)


@query("OR5_page_beyond_end", _page_sql(10**9, 30))
def _(fx):
    return _page(fx, 10**9, 30)


@query("SRC7_after_cursor", "select seq, type, job_id from V_job_events where seq > (select max(event_id) // 2 from events)")
def _(fx):
    cursor = F.lit(fx.events.agg(F.expr("max(event_id) div 2")).first()[0])
    return S.after_cursor(fx.V_job_events, "seq", cursor).select("seq", "type", "job_id")


@query("SRC7_high_water", "select max(event_id) as high_water from events")
def _(fx):
    return S.high_water(fx.V_job_events, "seq", F.lit(5).cast("bigint"))


@query("SRC8_newest", f"select seq, line from V_log order by seq desc limit {fixed.KEEP_LOG_LINES}")
def _(fx):
    return S.newest(fx.V_log, "seq", fixed.KEEP_LOG_LINES)


@query("SRC8_newest_per_job", f"select job_id, seq from (select job_id, seq, row_number() over (partition by job_id order by seq desc) as rn from V_job_events) where rn <= {fixed.KEEP_JOBS}")
def _(fx):
    return S.newest_per_key(fx.V_job_events.select("job_id", "seq"), ["job_id"], "seq", fixed.KEEP_JOBS)


_OLD = "select id, name, url, cast(null as string) as source, narrator, cast(null as string) as latest_url from V_series where enabled is not null"
_NEW = """select name, case when id % 3 = 0 then 'https://new/' else null end as url, 'given' as source, cast(null as string) as narrator, concat('/chapter/', cast(id as string)) as latest_url, id as seq from V_series where id % 2 = 0 or enabled is null
    union all select name, 'https://later/', cast(null as string), case when id % 4 = 0 then concat('voice of ', name) end, cast(null as string), id + 1000 from V_series where id % 4 = 0 or enabled is null"""


@query(
    "MUT1_upsert_series",
    f"""with o as ({_OLD}), c as ({_NEW}),
        n as (select name, arg_max(url, seq) as url, arg_max(source, seq) as source, arg_max(narrator, seq) as narrator, arg_max(latest_url, seq) as latest_url from c group by name),
        f as (select name, row_number() over (order by name) + (select max(id) from o) as id from n where name not in (select name from o))
        select coalesce(o.id, f.id) as id, coalesce(n.name, o.name) as name, coalesce(n.url, o.url) as url, coalesce(n.source, o.source) as source, coalesce(n.narrator, o.narrator) as narrator,
          coalesce(n.latest_url, o.latest_url) as latest_url, case when n.name is not null then '2024-03-02' else '2024-01-01' end as updated_at, case when o.name is null then '2024-03-02' else '2024-01-01' end as created_at
        from o full join n on n.name = o.name left join f on f.name = n.name""",
)
def _(fx):
    old = fx.sql(_OLD)
    for c in ("last_scraped_at", "created_at", "updated_at"):
        old = old.withColumn(c, F.expr("timestamp '2024-01-01'"))
    rows = S.upsert_series(old, fx.sql(_NEW), now())
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("id", "name", "url", "source", "narrator", "latest_url", day("updated_at"), day("created_at"))


_FRESH = "select concat('src', cast(series_id as string)) as series, raw_path, length(raw_path) as seq from V_files where not contains(raw_path, '_cleaned')"


@query("JN8_register_unseen", f"select raw_path, series from ({_FRESH}) f where raw_path not in (select raw_path from V_chapters where lang <> 'de')")
def _(fx):
    kept = fx.V_chapters.where("lang <> 'de'")
    return S.register(kept, fx.sql(_FRESH)).select("raw_path", "series")


@query(
    "MUT2_register_with_series",
    f"""with f as ({_FRESH}), known as (select * from V_series where enabled is not null)
        select 'chapter' as added, raw_path as name, row_number() over (order by seq, raw_path) + (select max(id) from V_chapters where lang <> 'de') as id, (select min(k.id) from known k where k.name = n.series) as series_id
          from (select raw_path, min(seq) as seq, arg_min(series, seq) as series from f where raw_path not in (select raw_path from V_chapters where lang <> 'de') group by raw_path) n
        union all select distinct 'series', series, null, null from f where series not in (select name from known)""",
)
def _(fx):
    fresh, kept = fx.sql(_FRESH), fx.V_chapters.where("lang <> 'de'")
    known = fx.V_series.where("enabled is not null")
    added = S.with_ids(S.register(kept, fresh), kept, known)
    chapters = added.select(F.lit("chapter").alias("added"), F.col("raw_path").alias("name"), "id", "series_id")
    series = S.missing_series(fresh, known).select(F.lit("series").alias("added"), "name")
    return chapters.unionByName(series, allowMissingColumns=True)


_SAVES = "select concat(source, '_', cast(n_chars % 100 as string)) as file_name, doc_id from documents"


@query(
    "SNK2_write_once",
    f"""with s as ({_SAVES}), old as (select s.file_name from s join labels l on l.doc_id = s.doc_id and l.toxic = 1)
        select doc_id, file_name, row_number() over (partition by file_name order by doc_id) = 1 and file_name not in (select file_name from old) as written from s""",
)
def _(fx):
    saves = fx.sql(_SAVES)
    existing = saves.join(fx.labels.where("toxic = 1"), "doc_id", "left_semi").select("file_name")
    return S.write_once(existing, saves, ["file_name"], "doc_id").select("doc_id", "file_name", "written")


_PROGRESS = "select raw_path, id % 101 as pct from V_chapters where id % 5 <> 2 union all select raw_path, id % 50 from V_chapters where id % 3 = 0"


@query("JN10_progress_overlay", f"select c.id, case when c.status = 'processing' then p.pct end as pct from V_chapters c left join (select raw_path, max(pct) as pct from ({_PROGRESS}) q group by raw_path) p on p.raw_path = c.raw_path")
def _(fx):
    return S.overlay_progress(fx.V_chapters, fx.sql(_PROGRESS)).select("id", "pct")


@query("JN9_requested_ids", "select id, title from V_chapters where id in (select doc_id from labels)")
def _(fx):
    from ..operators.compare import keep_ids

    return keep_ids(fx.V_chapters, fx.labels.select(F.col("doc_id").alias("id"))).select("id", "title")


@query("FN20_error_class", "select id, case when error is null then null when contains(error, '\\\\') or contains(error, 'disk I/O error') or regexp_extract(error, 'WinError ([0-9]+)', 1) in ('53', '64', '67', '1231') then 'network' else 'other' end as kind from V_chapters")
def _(fx):
    return fx.V_chapters.select("id", S.error_class(F.col("error")).alias("kind"))


_LASTS = """select id,
    arg_max(kind, seq) filter (where kind <> 'checked') as status,
    arg_max(coalesce(case when kind = 'failed' then error end, '-'), seq) filter (where kind in ('done', 'failed')) as error,
    arg_max(coalesce(output_path, '-'), seq) filter (where kind = 'processing' or (kind = 'done' and output_path is not null)) as output_path,
    arg_max(duration_s, seq) filter (where kind = 'done' and output_path is not null and duration_s is not null) as duration_s,
    arg_max(ts, seq) as updated_at, count(*) filter (where kind = 'failed') as fails from V_moves group by id"""


@query(
    "MUT3_transitions",
    f"""with m as ({_LASTS}) select c.id, coalesce(m.status, c.status) as status, case when m.error is null then c.error else nullif(m.error, '-') end as error,
          case when m.output_path is null then c.output_path else nullif(m.output_path, '-') end as output_path, coalesce(m.duration_s, c.duration_s) as duration_s,
          c.retry_count + coalesce(fails, 0) as retry_count, strftime(coalesce(m.updated_at, c.updated_at), '%Y-%m-%d %H:%M:%S') as updated_at
        from V_chapters c left join m on m.id = c.id""",
)
def _(fx):
    chapters = conform(fx.V_chapters, CHAPTERS)
    rows = S.apply_transitions(chapters, fx.V_moves)
    return rows.select("id", "status", "error", "output_path", "duration_s", F.col("retry_count").cast("bigint").alias("retry_count"), ts("updated_at"))


@query("MUT4_reset_processing", f"select id, case when status = 'processing' then 'pending' else status end as status, strftime(case when status = 'processing' then {NOW} else updated_at end, '%Y-%m-%d') as day from V_chapters")
def _(fx):
    return S.reset_processing(fx.V_chapters, now()).select("id", "status", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query("AG12_rows_reset", "select count(*) as reset from V_state_big where status = 'processing'")
def _(fx):
    return S.affected(fx.V_state_big)


@query(
    "MUT5_reset_chapters",
    "select c.id, case when l.doc_id is null then status else 'pending' end as status, case when l.doc_id is null then error end as error, case when l.doc_id is null then output_path end as output_path, retry_count from V_chapters c left join labels l on l.doc_id = c.id and l.toxic = 1",
)
def _(fx):
    ids = fx.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))
    return S.reset_chapters(fx.V_chapters, ids, now()).select("id", "status", "error", "output_path", "retry_count")


# the five steps one after the other, each a table of its own
_SYNC = f"""with s0 as (select id, series_id, title, raw_path, output_path, status from V_chapters where lang <> 'de'),
    files as (select f.* from V_files f join V_series s on s.id = f.series_id where f.raw_path not like '%\\_cleaned.txt' escape '\\'),
    s1 as (select *, case when status = 'processing' then 'pending' else status end as st, status = 'processing' as reset from s0),
    s2 as (select id, series_id, raw_path, output_path, st, reset, false as registered from s1
           union all select null, series_id, raw_path, null, 'pending', false, true from files f where not exists (select 1 from s1 where s1.raw_path = f.raw_path)),
    o as (select replace(regexp_replace(path, '\\.(mp3|wav)$', ''), '/lib/', '') as stem, min(case when path like '%.mp3' then path end) as mp3, min(case when path like '%.wav' then path end) as wav from V_outputs group by 1),
    s3 as (select s2.*, coalesce(mp3, wav) as found, st <> 'done' and coalesce(mp3, wav) is not null as marked from s2 left join o on o.stem = replace(replace(replace(s2.raw_path, '/raws/', '/'), '.txt', ''), '/lib/', '')),
    s4 as (select *, case when marked then 'done' else st end as st3, case when marked then found else output_path end as out3 from s3),
    s5 as (select *, st3 = 'done' and out3 is not null and out3 not in (select path from V_outputs) as reverted, raw_path not in (select raw_path from files) as removed from s4),
    fin as (select id, series_id, raw_path, case when reverted then 'pending' else st3 end as status, case when reverted then null else out3 end as output_path, reset, registered, marked, reverted, removed from s5)"""


def _reconciled(fx):
    state = fx.V_chapters.where("lang <> 'de'")
    return S.reconcile(state, fx.V_files, fx.V_outputs, fx.V_series, now())


@query("JN7_reconcile_actions", _SYNC + " select raw_path, concat_ws('+', case when reset then 'reset' end, case when registered then 'registered' end, case when marked then 'marked' end, case when reverted then 'reverted' end, case when removed then 'removed' end) as actions from fin")
def _(fx):
    return _reconciled(fx).select("raw_path", F.array_join("actions", "+").alias("actions"))


@query("MUT6_reconcile", _SYNC + " select id, series_id, raw_path, status, output_path from fin where not removed")
def _(fx):
    return S.surviving(_reconciled(fx)).select("id", "series_id", "raw_path", "status", "output_path")


@query("AG11_reconcile_report", _SYNC + " select action, count(*) as n from (select unnest([case when reset then 'reset' end, case when registered then 'registered' end, case when marked then 'marked' end, case when reverted then 'reverted' end, case when removed then 'removed' end]) as action from fin) where action is not null group by action")
def _(fx):
    return S.reconcile_report(_reconciled(fx))
