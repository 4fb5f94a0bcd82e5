"""Views over the given tables in the shape of the state tables, for queries and their checks.

A view is one SQL text that Spark and DuckDB read alike, or a pair of texts where explode,
ordered joins of strings or time arithmetic differ between the two.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import row_number_by, successor
from ..session import spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BOTH = {
    "V_series": """
        select id, concat('src', cast(id as string)) as name,
          case id % 3 when 0 then concat('https://www.royalroad.com/fiction/', cast(id as string))
                      when 1 then concat('https://www.scribblehub.com/series/', cast(id as string))
                      else 'local' end as url,
          concat('voice', cast(id % 5 as string)) as narrator,
          case when id % 4 = 0 then null when id % 7 = 0 then false else true end as enabled
        from (select distinct cast(substr(source, 4) as bigint) as id from documents) s""",
    "V_chapters": """
        select id, series_id, series, concat('Chapter ', cast(n as string), ' - ', series) as title, day as published_date,
          case id % 6 when 0 then null when 1 then '' else concat('https://www.royalroad.com/fiction/', cast(series_id as string), '/chapter/', cast(990000 + id * 1000 as string)) end as source_url,
          case when id % 5 <> 0 then 990000 + id * 1000 end as chapter_index,
          concat('/lib/', series, '/raws/', base, '.txt') as raw_path,
          case when status = 'done' and id % 9 <> 0 then concat('/lib/', series, '/', base, case when id % 2 = 0 then '.mp3' else '.wav' end) end as output_path,
          status,
          case when status <> 'failed' then null
               when id % 4 = 0 then concat('cannot open \\\\nas\\share\\', series)
               when id % 4 = 1 then 'disk I/O error'
               when id % 4 = 2 then concat('[WinError ', cast(50 + id % 20 as string), '] gone')
               else 'garbled audio' end as error,
          cast(case when status = 'failed' then id % 3 + 1 else 0 end as int) as retry_count,
          cast(date '2024-03-01' - cast(id % 60 as int) as timestamp) as updated_at,
          case when status = 'done' then n_chars / 15.0E0 end as duration_s,
          lang, text
        from (select d.doc_id as id, cast(substr(d.source, 4) as bigint) as series_id, d.source as series, d.doc_id % 50 as n, d.n_chars, d.lang, d.text,
                cast(date '2024-01-01' + cast(d.doc_id % 365 as int) as string) as day,
                concat(cast(date '2024-01-01' + cast(d.doc_id % 365 as int) as string), '_Chapter ', cast(d.doc_id % 50 as string), ' - ', d.source, ' p', cast(d.doc_id as string)) as base,
                case when l.doc_id is null then 'pending' when l.toxic = 1 then 'failed' when l.quality = 1 then 'done' else 'processing' end as status
              from documents d left join labels l on l.doc_id = d.doc_id) c""",
    "V_state_big": """
        select o_orderkey as id, o_custkey as series_id,
          case when o_orderpriority = '1-URGENT' then 'failed' when o_orderstatus = 'F' then 'done' when o_orderstatus = 'O' then 'pending' else 'processing' end as status,
          cast(o_orderdate as timestamp) as updated_at, o_totalprice / 100 as duration_s
        from orders""",
    "V_marked": """
        select doc_id, source, lang, n_chars,
          concat(text, '
[Level ', cast(doc_id % 90 as string), '] gained +', cast(n_chars as string), ' exp , at ', cast(doc_id as string), '/', cast(n_chars as string), ' mp/s | total ', cast(n_chars * 977 * (doc_id + 1) as string), ' and -7 HPS, 50%.') as text
        from documents""",
    "V_config": """
        select id, concat('src', cast(id as string)) as series, narrator,
          concat('voice', cast(id % 5 as string)) as map_user, concat('voice', cast((id + 1) % 5 as string)) as map_assistant,
          concat('voice', cast(id % 2 as string)) as system_voice, id % 2 = 1 as has_words
        from V_series""",
    "V_voices": "select distinct concat('voice', cast(id % 4 as string)) as voice_name from V_series",
    "V_snap": """
        select doc_id as id, concat('u/', cast(doc_id as string)) as source_url,
          case when doc_id % 13 <> 0 then text end as old_text,
          case when doc_id % 7 = 0 then concat(text, '
Extra line ', cast(doc_id as string)) else text end as new_text,
          case when doc_id % 17 = 3 then null else doc_id % 11 <> 0 end as available
        from documents""",
    "V_files": """
        select series_id, raw_path from V_chapters where id % 17 <> 0
        union all
        select series_id, concat('/lib/', series, '/raws/2025-02-01_New ', cast(id as string), '.txt') from V_chapters where id % 19 = 0
        union all
        select series_id, concat('/lib/', series, '/raws/2025-02-01_New ', cast(id as string), '_cleaned.txt') from V_chapters where id % 23 = 0""",
    "V_outputs": """
        select series_id, replace(replace(raw_path, '/raws/', '/'), '.txt', '.mp3') as path from V_chapters where id % 3 = 0
        union all
        select series_id, replace(replace(raw_path, '/raws/', '/'), '.txt', '.wav') from V_chapters where id % 5 = 0
        union all
        select series_id, concat('/lib/', series, '/2025-02-01_New ', cast(id as string), '.wav') from V_chapters where id % 38 = 0""",
    "V_moves": """
        select event_id as seq, user_id as id,
          case event_type when 'view' then 'processing' when 'purchase' then 'done' when 'error' then 'failed' else 'checked' end as kind,
          case when event_type = 'view' or value > 20 then concat('/out/', cast(event_id as string), '.mp3') end as output_path,
          case when event_type = 'error' then concat('bad ', cast(event_id as string)) end as error,
          case when event_id % 3 <> 0 then value end as duration_s,
          cast(ts as timestamp) as ts
        from events""",
    "V_cursors": """
        select id, name, concat('/chapter/', cast(id as string)) as before,
          case when id % 3 = 0 then concat('/chapter/', cast(id + 100 as string)) else concat('/chapter/', cast(id as string)) end as after,
          case when id % 4 = 0 then concat('/chapter/', cast(id + 7 as string)) else concat('/chapter/', cast(id as string)) end as fresh
        from V_series""",
    "V_timing": """
        select concat('voice', cast(user_id % 5 as string)) as voice, value as wall_s, cast(k as double) as audio_s from V_k""",
    "V_job_events": """
        select event_id as seq, ts, cast(user_id as string) as job_id,
          case event_type when 'signup' then case when k % 3 = 0 then 'phase_started' else 'series_started' end
             when 'view' then 'chapter_started' when 'click' then 'chunk_progress' when 'purchase' then 'chapter_done' else 'chapter_failed' end as type,
          concat('s', cast(k % 7 as string)) as series, concat('Chapter ', cast(k as string)) as chapter,
          concat('/raw/', cast(user_id as string), '/', cast(k as string)) as raw_path,
          cast(k as bigint) as chars_done, cast(case when k % 10 = 9 then 0 else 100 end as bigint) as chars_total,
          cast(k % 7 + 1 as int) as index, cast(7 as int) as total,
          case when k % 2 = 0 then 'scrape' else 'audio' end as message, case when event_type = 'error' then 'boom' end as error
        from V_k""",
    "V_jobs": """
        select event_id as id, concat(cast(user_id % 10 as string), '/', event_type) as key, user_id, event_type, ts as created,
          value, k,
          case event_type when 'purchase' then 'done' when 'error' then 'failed' when 'click' then 'cancelled' else 'running' end as status,
          case k % 6 when 0 then 'full_pipeline' when 1 then 'scrape_all' when 2 then 'scrape_series' when 3 then 'generate_series' when 4 then 'regenerate_chapter' else 'rescrape_chapter' end as job_type
        from V_k""",
    "V_log": """
        select event_id as seq,
          concat(case when k % 7 = 0 then concat(chr(27), '[32m') else '' end,
            case when k % 10 = 0 then concat('[t] gen ', cast(k as string))
                 when k % 31 = 7 then '[queue] failed: The Plan'
                 when k % 31 = 8 then '[queue] queued: The Failed Experiment'
                 when k % 31 = 9 then '[sync] src1: reset 2'
                 when k % 31 = 11 then 'plain note'
                 when k % 31 = 12 then 'Warning: odd'
                 else case event_type when 'signup' then concat('[', cast(k + 1 as string), '/100] ', case when k % 2 = 0 then 'Scraping' else 'Generating' end, ' s', cast(user_id as string))
                   when 'view' then concat(chr(9), 'Chapter ', cast(k as string)) when 'click' then concat(chr(9), 'Saved!') when 'purchase' then concat(chr(9), 'Converted to MP3!')
                   else concat(chr(9), 'Error on TTS: ', cast(k as string)) end end,
            case when k % 7 = 0 then concat(chr(27), '[0m') else '' end) as line
        from V_k""",
}

PAIRS = {
    "V_k": (
        "select event_id, cast(ts as timestamp) as ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events",
        "select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events",
    ),
    "V_lines": (
        "select doc_id, cast(pos as bigint) as pos, line from documents lateral view posexplode(split(text, '[\\n]', -1)) t as pos, line",
        "select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)",
    ),
    "V_block": (
        "select item_id * 10000 + min(pos) as item_id, message from (select item_id, pos, trim(line) as message from benchmark lateral view posexplode(split(text, '[\\n]', -1)) t as pos, line) b where message <> '' group by item_id, message",
        "select item_id * 10000 + min(pos) as item_id, message from (select item_id, unnest(range(len(l))) as pos, trim(unnest(l)) as message from (select item_id, string_split(text, chr(10)) as l from benchmark)) where message <> '' group by item_id, message",
    ),
    "V_tagged": (
        """select conv_id, listagg(s, '
') within group (order by turn) as text from (select conv_id, turn, case when role = 'user' and turn % 4 <> 2 then text else concat('<<SPEAKER=', case when said % 6 = 3 then 'System' when said % 10 = 1 then 'default' else voice end, '>>', text, '<</SPEAKER>>') end as s
            from (select conv_id, turn, role, text, case when role = 'user' and turn % 4 = 2 then turn - 1 else turn end as said, case when role = 'user' and turn % 4 = 2 then coalesce(lag(role) over (partition by conv_id order by turn), 'system') else role end as voice from conversations) w) t group by conv_id""",
        """select conv_id, string_agg(s, chr(10) order by turn) as text from (select conv_id, turn, case when role = 'user' and turn % 4 <> 2 then text else concat('<<SPEAKER=', case when said % 6 = 3 then 'System' when said % 10 = 1 then 'default' else voice end, '>>', text, '<</SPEAKER>>') end as s
            from (select conv_id, turn, role, text, case when role = 'user' and turn % 4 = 2 then turn - 1 else turn end as said, case when role = 'user' and turn % 4 = 2 then coalesce(lag(role) over (partition by conv_id order by turn), 'system') else role end as voice from conversations) w) t group by conv_id""",
    ),
    "V_chunks": (
        "select doc_id, cast(0 as bigint) as part_pos, pos as chunk_idx, concat('voice', cast(pos % 3 as string)) as speaker, false as is_system, line as text, cast(length(line) as bigint) as chars from V_lines",
        "select doc_id, cast(0 as bigint) as part_pos, pos as chunk_idx, concat('voice', cast(pos % 3 as string)) as speaker, false as is_system, line as text, cast(length(line) as bigint) as chars from V_lines",
    ),
    "V_toc": (
        "select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as series, page_id as pos, page_id as chapter_order, regexp_extract(html, '<title>([^<]*)</title>', 1) as link_text, url, case when page_id % 3 <> 0 then cast(date '2024-01-01' + cast(page_id % 365 as int) as string) end as pub_date from pages",
        "select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as series, page_id as pos, page_id as chapter_order, regexp_extract(html, '<title>([^<]*)</title>', 1) as link_text, url, case when page_id % 3 <> 0 then cast(date '2024-01-01' + cast(page_id % 365 as int) as string) end as pub_date from pages",
    ),
    "V_links": (
        None,
        """select series, url, case when nxt is not null then concat('/chapter/', nxt) when series % 10 = 0 then concat('/chapter/', first_key) end as next_url, rn, key from (
             select o_custkey as series, concat('/chapter/', o_orderkey) as url, o_orderkey as key, row_number() over w as rn,
               lead(o_orderkey) over w as nxt, min(o_orderkey) over (partition by o_custkey) as first_key
             from orders window w as (partition by o_custkey order by o_orderkey))""",
    ),
    "V_work": (
        "select * from V_jobs",
        "select *, created + to_microseconds(cast(round(value * 60) as bigint) * 1000000) as finished from V_jobs",
    ),
}

_VIEW = re.compile(r"\bV_[a-z_]+\b")


class Fixtures:
    """Tables and views of one data folder as DataFrames, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = self._build(name)
        return made[name]

    @cached_property
    def dealt(self) -> Fixtures:
        """The same tables with their texts dealt out to all cores, for costly work per text."""
        other = Fixtures(self.spark, self.dir)
        other._made.update(documents=spread(self.documents), pages=spread(self.pages))
        return other

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name == "V_links":
            return self._links()
        if name == "V_work":
            took = F.expr("make_interval(0, 0, 0, 0, 0, 0, round(value * 60))")
            return self.V_jobs.withColumn("finished", F.col("created") + took)
        return self.sql(BOTH.get(name) or PAIRS[name][0])

    def sql(self, text: str) -> DataFrame:
        """A query over tables and views by name."""
        names = [n for n in {*_VIEW.findall(text), *[t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]}]
        args = {n: getattr(self, n) for n in names}
        escaped = text.replace("{", "{{").replace("}", "}}").replace("\\", "\\\\")
        for n in names:
            escaped = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", escaped)
        return self.spark.sql(escaped, **args)

    def _links(self) -> DataFrame:
        rows = self.orders.select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("key"))
        ranked = row_number_by(rows, ["series"], [F.asc("key")], [F.expr("key div 65536")])
        linked = successor(ranked, ["series"], "rn", {"key": "nxt"})
        first = rows.groupBy("series").agg(F.min("key").alias("first_key"))
        url = lambda c: F.concat(F.lit("/chapter/"), F.col(c).cast("string"))
        nxt = F.when(F.col("nxt").isNotNull(), url("nxt")).when(F.col("series") % 10 == 0, url("first_key"))
        return linked.join(first, "series").select("series", url("key").alias("url"), nxt.alias("next_url"), "rn", "key")


def duckdb_text(text: str) -> str:
    """Put the views a DuckDB query names in front of it, in order of need."""
    order: list[str] = []

    def need(body: str):
        for name in _VIEW.findall(body):
            if name not in order and (name in BOTH or name in PAIRS):
                need(BOTH.get(name) or PAIRS[name][1])
                if name not in order:
                    order.append(name)

    need(text)
    views = [f"{n} as ({BOTH.get(n) or PAIRS[n][1]})" for n in order]
    body = text.strip()
    m = re.match(r"with\s+(recursive\s+)?", body, re.I)
    recursive = "recursive " if m and m.group(1) else ""
    if m:
        return f"with {recursive}" + ",\n".join(views + [body[m.end() :]])
    return ("with " + ",\n".join(views) + "\n" if views else "") + body
