"""Listings, chains, re-read text and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import compare as C
from ..operators.chains import follow_links
from ..operators.state import first_per_key
from .registry import query
from .state import now
from .text import WORD, nested

_KEY = lambda c: f"trim(regexp_replace(regexp_replace(lower({nested(c, fixed.TITLE_CHARACTERS)}), '[^{WORD}\\s]', '', 'g'), '\\s+', ' ', 'g'))"

# stored chapters of the hosts: each listed title in another spelling, and one title that is not listed
_STORED = """select pos as id, series, case when pos % 9 = 4 then 'Not listed' else concat(' ', replace(link_text, ' ', '  '), ' !') end as title,
    case when pos % 4 = 0 then null when pos % 4 = 1 then '' else concat(url, '/old') end as source_url, concat('d', cast(pos % 5 as string)) as published_date, url from V_toc"""


@query(
    "JN3_match_titles",
    f"""with c as ({_STORED}), t as (select series, {_KEY('link_text')} as key, arg_min(url, pos) as resolved from V_toc group by 1, 2)
        select c.id, t.resolved from c left join t on t.series = c.series and t.key = {_KEY('c.title')}""",
)
def _(fx):
    return C.resolve_urls(fx.sql(_STORED), fx.V_toc, strip_names=False).select("id", "resolved")


@query(
    "JN5_fill_urls",
    f"""with c as ({_STORED}), t as (select series, {_KEY('link_text')} as key, arg_min(url, pos) as resolved from V_toc group by 1, 2)
        select c.id, coalesce(nullif(c.source_url, ''), t.resolved, c.source_url) as source_url from c left join t on t.series = c.series and t.key = {_KEY('c.title')}""",
)
def _(fx):
    return C.fill_urls(fx.sql(_STORED), fx.V_toc, strip_names=False).select("id", "source_url")


# the same with the series' name, the site's and a tag about the titles
_DRESSED = f"""select id, series, case id % 4 when 0 then concat(title, ' - ', upper(series), ' | {fixed.TITLE_SITE_SUFFIX}') when 1 then concat(series, ' ', title)
    when 2 then concat(title, ' [Book 2]') else title end as title, source_url from ({_STORED}) s"""


def _bare(rel, title, out):
    """``rel`` with the title without them as ``bare``: a chain of tables that ends in ``out``."""
    site = fixed.TITLE_SITE_SUFFIX
    return f"""{out}1 as (select *, case when contains({title}, ' | {site}') then trim(split_part({title}, ' | {site}', 1)) when ends_with({title}, ' {site}') then trim({title}[:-{len(site) + 2}]) else {title} end as t1 from {rel}),
        {out}2 as (select *, string_split(trim(regexp_replace(t1, '\\s*\\[[^\\]]*\\]\\s*$', '')), ' - ') as w from {out}1),
        {out}3 as (select *, list_max(list_filter(range(1, len(w)), lambda k: contains(lower(array_to_string(w[k + 1:], ' - ')), series))) as last from {out}2),
        {out}4 as (select *, trim(array_to_string(w[:coalesce(last, len(w))], ' - ')) as t3 from {out}3),
        {out} as (select *, case when starts_with(lower(t3), series) and trim(substr(t3, length(series) + 1)) <> '' then trim(substr(t3, length(series) + 1)) else t3 end as bare from {out}4)"""


_LISTED = f"""with s as ({_DRESSED}), {_bare('s', 'title', 'c')}, {_bare('V_toc', 'link_text', 'l')},
        t as (select series, {_KEY('bare')} as key, arg_min(url, pos) as resolved from l group by 1, 2)"""


@query("JN3_match_dressed_titles", f"{_LISTED} select c.id, t.resolved from c left join t on t.series = c.series and t.key = {_KEY('c.bare')}")
def _(fx):
    return C.resolve_urls(fx.sql(_DRESSED), fx.V_toc).select("id", "resolved")


@query(
    "JN5_fill_dressed_urls",
    f"{_LISTED} select c.id, coalesce(nullif(c.source_url, ''), t.resolved, c.source_url) as source_url from c left join t on t.series = c.series and t.key = {_KEY('c.bare')}",
)
def _(fx):
    return C.fill_urls(fx.sql(_DRESSED), fx.V_toc).select("id", "source_url")


@query(
    "JN4_listed_dates",
    f"""with c as (select id, published_date, case when id % 6 = 0 then 'x' else url end as source_url from ({_STORED}) s), d as (select url, arg_max(pub_date, pos) as day from V_toc where pub_date is not null group by url)
        select c.id, coalesce(d.day, c.published_date) as published_date from c left join d on d.url = c.source_url""",
)
def _(fx):
    rows = fx.sql(f"select id, published_date, case when id % 6 = 0 then 'x' else url end as source_url from ({_STORED}) s")
    return C.dates_with_fallback(rows, fx.V_toc).select("id", "published_date")


_HREFS = "select page_id as page, 0 as pos, url from pages union all select page_id, 1, concat('/', regexp_extract(html, 'href=\"/([^\"]*)\"', 1)) from pages"


@query("SET2_distinct_links", f"select url, page, pos from (select *, row_number() over (partition by url order by page, pos) as rn from ({_HREFS})) where rn = 1")
def _(fx):
    return C.distinct_links(fx.sql(_HREFS)).select("url", "page", "pos")


_NEXT = """with w as (select series, url, pos, lead(url) over (partition by series order by pos) as nxt from V_toc),
    f as (select series, split_part(rtrim(url, '/'), '?', 1) as norm, arg_min(nxt, pos) as next_url from w where nxt is not null group by 1, 2)
    select t.pos, f.next_url from V_toc t left join f on f.series = t.series and f.norm = split_part(rtrim(t.url, '/'), '?', 1)"""


@query("WN8_next_listed", _NEXT)
def _(fx):
    return C.next_listed(fx.V_toc.select("series", "pos", "url"), fx.V_toc).select("pos", "next_url")


@query("WN8_next_listed_hot_keys", _NEXT)
def _(fx):
    return C.next_listed(fx.V_toc.select("series", "pos", "url"), fx.V_toc, block=4, hot_rows=1).select("pos", "next_url")


@query(
    "WN9_follow_links",
    """with recursive l as (select * from V_links), w(series, hop, url, seen) as (
          select series, cast(0 as bigint), url, [url] from l where rn = 1
          union all select l.series, w.hop + 1, l.next_url, list_append(w.seen, l.next_url) from w join l on l.series = w.series and l.url = w.url
          where l.next_url is not null and not list_contains(w.seen, l.next_url))
        select series, hop, url from w""",
)
def _(fx):
    links = fx.V_links
    starts = links.where("rn = 1").select("series", "url")
    return follow_links(links, starts, ["series"])


_CHANGE = """select id, case when not available then 'unavailable' else 'changed' end as change from V_snap
    where source_url <> '' and (not available or (available and coalesce(old_text, '') <> new_text))"""


def changes(fx):
    old = fx.V_snap.select("id", "source_url", "old_text")
    return C.compare_snapshots(old, fx.V_snap.select("id", "new_text", "available"))


@query("JN6_compare_snapshots", _CHANGE)
def _(fx):
    return changes(fx).select("id", "change")


@query("AG10_change_summary", f"select count(*) filter (where change = 'changed') as changed, count(*) filter (where change = 'unavailable') as unavailable from ({_CHANGE})")
def _(fx):
    return C.change_summary(changes(fx))


@query("CMP1_line_diff")
def _(fx):
    diff = C.line_diff(changes(fx).where("change = 'changed'"))
    lines = F.transform("lines", lambda x: F.concat_ws(" ", x["kind"], x["text"]))
    return diff.select("id", "added", "removed", F.array_join(lines, "\n").alias("diff"))


_COUNTS = f"""with c as (select s.id, s.old_text, s.new_text from V_snap s join ({_CHANGE}) x on x.id = s.id and x.change = 'changed'),
        l as (select id, unnest(string_split(coalesce(old_text, ''), chr(10))) as line, -1 as n from c where coalesce(old_text, '') <> '' union all select id, unnest(string_split(new_text, chr(10))), 1 from c),
        g as (select id, line, sum(n) as n from l where line <> '' or n < 0 group by id, line)
        select id, cast(sum(greatest(n, 0)) as bigint) as added, cast(sum(greatest(-n, 0)) as bigint) as removed from g group by id"""


# lines are added and none is moved in these tables, so the counts of the diff are those of the lines
@query("AG9_diff_counts", _COUNTS)
def _(fx):
    return C.line_diff(changes(fx).where("change = 'changed'")).select("id", "added", "removed")


@query(
    "CMP2_line_counts",
    f"""with c as (select s.id, s.old_text, s.new_text from V_snap s join ({_CHANGE}) x on x.id = s.id and x.change = 'changed'),
        l as (select id, unnest(string_split(coalesce(old_text, ''), chr(10))) as line, -1 as n from c union all select id, unnest(string_split(new_text, chr(10))), 1 from c),
        g as (select id, line, sum(n) as n from l group by id, line)
        select id, cast(sum(greatest(n, 0)) as bigint) as added, cast(sum(greatest(-n, 0)) as bigint) as removed from g group by id""",
)
def _(fx):
    return C.line_counts(changes(fx).where("change = 'changed'"))


@query(
    "MUT7_apply_texts",
    f"select s.id, case when c.id is not null then s.new_text else s.old_text end as text, c.id is not null as edited from V_snap s left join (select id from ({_CHANGE}) where change = 'changed') c on c.id = s.id",
)
def _(fx):
    texts = fx.V_snap.select("id", F.col("old_text").alias("text"))
    edits = changes(fx).where("change = 'changed'")
    earlier = edits.withColumn("new_text", F.lit("an edit before")).withColumn("seq", F.lit(1))
    return C.apply_texts(texts, earlier.unionByName(edits.withColumn("seq", F.lit(2))))


@query("MUT7_drop_derived", f"select doc_id as id, chunk_idx from V_chunks where doc_id not in (select id from ({_CHANGE}) where change = 'changed')")
def _(fx):
    derived = fx.V_chunks.select(F.col("doc_id").alias("id"), "chunk_idx")
    return C.drop_derived(derived, changes(fx).where("change = 'changed'"))


@query(
    "MUT8_apply_title_repairs",
    """with c as (select *, case when output_path is not null then regexp_extract(output_path, '\\.[a-z0-9]+$') end as ext, concat(published_date, '_Chapter ', cast(id % 50 as string)) as base from V_chapters)
       select id, concat('Chapter ', cast(id % 50 as string)) as title, concat('/lib/', series, '/raws/', base, '.txt') as raw_path,
         case when id % 6 = 0 and output_path is not null then '/lib/custom.mp3' when output_path in (select path from V_outputs) then concat('/lib/', series, '/', base, ext) else output_path end as output_path from c""",
)
def _(fx):
    # some outputs are files of another name, which stay where they are
    other = F.when(F.col("output_path").isNotNull() & (F.col("id") % 6 == 0), "/lib/custom.mp3").otherwise(F.col("output_path"))
    outputs = fx.V_outputs.select("path").union(fx.spark.range(1).select(F.lit("/lib/custom.mp3")))
    rows = C.apply_title_fixes(fx.V_chapters.withColumn("output_path", other), C.title_fixes(fx.V_chapters), outputs, now())
    return rows.select("id", "title", "raw_path", "output_path")


@query("SET3_changed_cursors", "select name, after from V_cursors where before is distinct from after")
def _(fx):
    return C.changed_cursors(fx.V_cursors).select("name", "after")


@query("MUT10_merge_cursors", "select name, case when before is distinct from after then after else fresh end as latest from V_cursors")
def _(fx):
    return C.merge_cursors(fx.V_cursors.select("name", F.col("fresh").alias("latest")), fx.V_cursors.select("name", "before", "after"))


@query("JN8_first_per_path", "select raw_path, min(seq) as seq from (select concat('/raw/', cast(user_id as varchar)) as raw_path, event_id as seq from events) group by raw_path")
def _(fx):
    rows = fx.events.select(F.concat(F.lit("/raw/"), F.col("user_id").cast("string")).alias("raw_path"), F.col("event_id").alias("seq"), "value")
    return first_per_key(rows, ["raw_path"], ["seq"]).select("raw_path", "seq")
