"""Pages and files. The test pages keep their content in <article> and their links in <nav>."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.base import explode_rows
from ..functions.text import clean_for_speech
from ..functions.titles import plain_title
from ..operators.boilerplate import clean_pages
from ..session import spread, work_path
from ..sources.files import read_chapters, write_cleaned
from ..sources.pages import SECOND_SITE, Profile, extract_pages, finish_pages, savable
from .registry import query
from .text import CLEANED, MESSAGES, MESSY, nested, paragraph_sql
from .. import fixed

SITE = Profile(content=("article", None, None), list_box=("nav", None, None), next_box=("nav", None, None), next_link=("a", None, None), next_word="")
NONE = "array<string>"


def parsed(fx, kinds=()):
    pages = fx.dealt.pages.withColumn("kinds", F.array(*[F.lit(k) for k in kinds]).cast(NONE))
    return extract_pages(pages, SITE, "kinds")




def unescape(expr):
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


_RAW = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("EXT1_titles", f"select page_id, {nested('trim(' + unescape(_RAW) + ')', fixed.TITLE_CHARACTERS)} as title from pages")
def _(fx):
    return parsed(fx).select("page_id", plain_title("title").alias("title"))


# documents as pages of the first site: titles with series, site and tag about them, a paragraph for each line
_PAGED = f"""select doc_id as page_id, concat('https://a.example/', cast(doc_id as string)) as url, source as series,
    concat('<html><head><title>', case doc_id % 3 when 0 then concat('Part ', cast(doc_id as string), ' - ', upper(source), ' | {fixed.TITLE_SITE_SUFFIX}')
        when 1 then concat(source, ' Part ', cast(doc_id as string), ' [Book 2]') else concat('Part ', cast(doc_id as string)) end,
        '</title></head><body><time datetime="2024-03-05T01:02:03Z"></time><div class="chapter-content"><p>',
        replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p><p>'), '</p></div></body></html>') as html
    from (select m.doc_id, m.text, d.source from ({MESSY}) m join documents d on d.doc_id = m.doc_id) t"""


def _whole_pages(fx, **kw):
    pages = clean_pages(fx.dealt.sql(_PAGED), fx.sql(MESSAGES), series="series", **kw)
    return pages.select("page_id", "title", "published_date", "text", "unavailable")


_WHOLE_SQL = f"""select d.doc_id as page_id, concat('Part ', d.doc_id) as title, '2024-03-05' as published_date, coalesce(x.text, '') as text, false as unavailable
    from documents d left join (select doc_id, string_agg(line, chr(10) order by pos) as text from ({paragraph_sql(True, True)}) p group by doc_id) x on x.doc_id = d.doc_id"""


@query("EXT1_whole_pages", _WHOLE_SQL)
def _(fx):
    return _whole_pages(fx)


@query("EXT1_whole_pages_long_list", _WHOLE_SQL)
def _(fx):
    """The same with the list treated as too long for a literal."""
    return _whole_pages(fx, max_rows=0)


# an open <b> takes in the rest of the article, so its top level holds the h1 and what follows it
@query("EXT2_content_lines")
def _(fx):
    pages = finish_pages(parsed(fx), F.array().cast(NONE), SITE)
    return savable(pages).select("page_id", "title", "published_date", "text")


@query("EXT2_heading_line", f"select page_id, trim(regexp_replace({unescape('regexp_extract(html, ' + chr(39) + '<h1>([^<]*)</h1>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g')) as line from pages")
def _(fx):
    return parsed(fx).select("page_id", F.regexp_replace(F.trim(F.get("lines", F.lit(0))), r"\s+", " ").alias("line"))


_TAKEN_DOWN = {
    0: "'<html><body><p>This chapter was Drafted or Deleted.</p></body></html>'",
    1: "'<html><body><div class=\"chapter-content\"><p>drafted or deleted</p></div></body></html>'",
}


@query(
    "EXT3_unavailable",
    """select page_id, page_id % 7 = 0 or page_id % 5 = 2 or (page_id % 7 > 1 and contains(lower(html), 'drafted or deleted') and not contains(html, 'chapter-content')) as unavailable,
       page_id % 5 = 2 as unavailable_elsewhere from pages""",
)
def _(fx):
    """Pages of which some are taken down, some only say so in their content, and some are missing by their status."""
    html = F.expr(f"case page_id % 7 when 0 then {_TAKEN_DOWN[0]} when 1 then {_TAKEN_DOWN[1]} else html end")
    pages = fx.pages.withColumn("html", html).withColumn("status", F.expr("case when page_id % 5 = 2 then 404 when page_id % 5 = 1 then 200 end"))
    here = extract_pages(pages, status="status").select("page_id", F.col("gone").alias("unavailable"))
    there = extract_pages(pages, SECOND_SITE, status="status").select("page_id", F.col("gone").alias("unavailable_elsewhere"))
    return here.join(there, "page_id")


@query("EXT4_voice_tags")
def _(fx):
    pages = finish_pages(parsed(fx, ("bold", "bracket", "angle")), F.array().cast(NONE), SITE)
    return pages.select("page_id", "text")


@query("EXT4_tagged_pages", "select page_id, contains(html, '<b>') as tagged from pages")
def _(fx):
    return parsed(fx, ("bold",)).select("page_id", F.contains(F.array_join("lines", "\n"), F.lit("<<SPEAKER=system>>")).alias("tagged"))


@query(
    "EXT6_listing_links",
    f"""with n as (select page_id, url as base, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">', 1) as hs, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1) as ts from pages),
        u as (select page_id, base, unnest(range(len(hs))) as pos, unnest(hs) as h, unnest(ts) as t from n)
        select page_id, pos, {unescape('t')} as link_text, regexp_extract(base, '^[a-z]+://[^/]+') || {unescape('h')} as url from u""",
)
def _(fx):
    rows = explode_rows(parsed(fx), F.col("links"), "l", "page_id")
    return rows.select("page_id", F.col("l.pos").cast("bigint").alias("pos"), "l.link_text", "l.url")


@query("EXT7_next_link", "select page_id, regexp_extract(url, '^[a-z]+://[^/]+') || regexp_extract(html, '(?s)<nav>.*?<a href=\"([^\"]*)\">', 1) as next_url from pages")
def _(fx):
    return parsed(fx).select("page_id", "next_url")


@query("EXT5_styling_off")
def _(fx):
    """Pages whose <b> stands as a light span: the same lines as without any styling."""
    light = fx.pages.withColumn("html", F.replace("html", F.lit("<b>"), F.lit('<span style="font-weight: 400">')))
    rows = extract_pages(spread(light), SITE)
    return rows.select("page_id", F.array_join("lines", "\n").alias("text"))


@query("SRC1_chapter_files", "select source, cast(sum(length(text) + 1) as bigint) as chars from documents group by source")
def _(fx):
    """Texts written as .txt files, one folder per source, and read back as whole files."""
    path = work_path(fx.spark, "raws")
    fx.documents.select("source", "text").write.partitionBy("source").text(path)
    files = read_chapters(fx.spark, path)
    source = F.regexp_extract("raw_path", r"source=([^/]+)/", 1).alias("source")
    return files.groupBy(source).agg(F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("SNK1_cleaned_files", "select source, count(*) as docs from documents group by source")
def _(fx):
    path = work_path(fx.spark, "cleaned")
    write_cleaned(fx.dealt.documents.select("doc_id", "source", clean_for_speech("text").alias("text")), path)
    return fx.spark.read.parquet(path).groupBy("source").agg(F.count("text").alias("docs"))


@query("SRC1_chapter_lines", "select source, line, count(*) as n from (select source, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) group by source, line")
def _(fx):
    """Every line of the files, told apart by content."""
    path = work_path(fx.spark, "raws")
    fx.documents.select("source", "text").write.partitionBy("source").text(path)
    files = read_chapters(fx.spark, path).withColumn("source", F.regexp_extract("raw_path", r"source=([^/]+)/", 1))
    lines = explode_rows(files, F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1), "line", "source")
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))


@query("SNK1_cleaned_texts", f"with {CLEANED} select doc_id, source, text from d")
def _(fx):
    path = work_path(fx.spark, "cleaned")
    write_cleaned(fx.dealt.documents.select("doc_id", "source", clean_for_speech("text").alias("text")), path)
    return fx.spark.read.parquet(path).select("doc_id", "source", "text")
