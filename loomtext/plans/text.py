"""Text rules over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions import titles as N
from ..functions.base import explode_rows
from ..functions.numbers import numbers_to_words
from ..operators.ranking import in_order
from ..operators.boilerplate import anchored_matches, attach_messages, clean_documents
from ..operators.compare import title_fixes
from ..session import broadcast_if_small
from .registry import query

WORD = r"\p{L}\p{M}\p{N}_"


def nested(expr: str, pairs) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    for a, b in pairs:
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


def sql_words(text: str, rules: dict[str, str], fold_case: bool) -> str:
    """Whole-word replacement in SQL: cut into word and other runs, map the word runs."""
    key = "lower(x)" if fold_case else "x"
    cases = " ".join(f"when {key} = '{a}' then '{b}'" for a, b in rules.items())
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[{WORD}]+|[^{WORD}]+'), lambda x: case {cases} else x end), '')"


def sql_acronyms(text: str) -> str:
    """mp/s and hp/s first become single words, which is the same as long as mps and hps mean the same."""
    joined = text
    for a in ("m", "h"):
        joined = f"regexp_replace({joined}, '(^|[^{WORD}])([{a}{a.upper()}][pP])/([sS])($|[^{WORD}])', '\\1\\2\\3\\4', 'g')"
    return sql_words(joined, {"exp": "E-X-P", "mps": "M-P-S", "hps": "H-P-S"}, True)


def sql_signs(text: str) -> str:
    for sign, word in (("\\+", "plus"), ("-", "minus")):
        text = f"regexp_replace({text}, '(^|[^{WORD}]){sign}([0-9])', '\\1{word} \\2', 'g')"
    return text


_TEENS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
_BIG = ["", *[f" {w}" for w in "thousand million billion trillion quadrillion quintillion sextillion septillion octillion nonillion decillion undecillion".split()]]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sql_numbers(text: str) -> str:
    """Numbers in words in SQL, for up to 38 digits."""
    r = f"case when g % 100 < 20 then {_list(_TEENS)}[g % 100 + 1] else {_list(_TENS)}[g % 100 // 10 + 1] || case when g % 10 > 0 then '-' || {_list(_TEENS)}[g % 10 + 1] else '' end end"
    group = f"case when g >= 100 then {_list(_TEENS)}[g // 100 + 1] || ' hundred' || case when g % 100 > 0 then ' and ' || ({r}) else '' end else {r} end"
    digits = "regexp_replace(x, '^[0,]+|,', '', 'g')"
    padded = f"lpad({digits}, 39, '0')"
    word_at = f"list_transform([cast(substr({padded}, 3 * p + 1, 3) as int)], lambda g: case when g > 0 then ({group}) || {_list(_BIG)}[13 - p] end)[1]"
    parts = f"list_filter(list_transform(range(13), lambda p: {word_at}), lambda w: w is not null)"
    tail = f"cast(substr({padded}, 37, 3) as int) between 1 and 99"
    words = f"list_transform([{parts}], lambda q: case when len(q) > 1 and {tail} then array_to_string(q[:-2], ', ') || ' and ' || q[-1] else array_to_string(q, ', ') end)[1]"
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+|[^0-9]+'), "
        f"lambda x: case when regexp_matches(x, '^[0-9]') and length({digits}) between 3 and 38 then {words} else x end), '')"
    )


SQL_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
CHARS = nested("text", fixed.SPEECH_CHARACTERS)


@query("FN1_speech_characters", f"select doc_id, {CHARS} as text from documents")
def _(fx):
    return fx.dealt.documents.select("doc_id", T.replace_characters("text").alias("text"))


@query("FN2_space_before_comma", "select doc_id, regexp_replace(replace(text, '|', ' ,'), '\\s+,', ',', 'g') as text from documents")
def _(fx):
    return fx.dealt.documents.select("doc_id", T.tighten_commas(F.replace("text", F.lit("|"), F.lit(" ,"))).alias("text"))


def with_config(fx, docs, on="source"):
    """Documents with the maps of their series."""
    words = F.create_map(F.lit("the"), F.lit("THE"), F.lit("que"), F.lit("Q$1"))
    config = fx.V_config.select(
        F.col("series").alias(on),
        "narrator",
        "system_voice",
        F.when(F.col("has_words"), words).alias("words"),
        F.create_map(F.lit("user"), "map_user", F.lit("assistant"), "map_assistant").alias("mappings"),
    )
    return docs.join(broadcast_if_small(config), on, "left")


@query(
    "FN3_series_words",
    f"select d.doc_id, case when c.has_words then {sql_words('d.text', {'the': 'THE', 'que': 'Q$1'}, False)} else d.text end as text from documents d join V_config c on c.series = d.source",
)
def _(fx):
    return with_config(fx, fx.dealt.documents).select("doc_id", T.replace_words("text", "words").alias("text"))


@query("FN4_acronyms", f"select doc_id, {sql_acronyms('text')} as text from V_marked")
def _(fx):
    return fx.dealt.V_marked.select("doc_id", T.expand_acronyms("text").alias("text"))


@query("FN4_acronyms_in_tagged_text", "select conv_id, regexp_replace(replace(text, '>>', '>> exp '), '>> exp ', '>> E-X-P ', 'g') as text from V_tagged")
def _(fx):
    return fx.V_tagged.select("conv_id", T.expand_acronyms(F.replace("text", F.lit(">>"), F.lit(">> exp "))).alias("text"))


@query("FN5_brackets", "select doc_id, regexp_replace(text, '\\[([^\\]\\n]*)\\]', '\\1', 'g') as text from V_marked")
def _(fx):
    return fx.dealt.V_marked.select("doc_id", T.unwrap_brackets("text").alias("text"))


@query("FN6_ratios", "select doc_id, regexp_replace(text, '([0-9]+)\\s*/\\s*([0-9]+)', '\\1 out of \\2', 'g') as text from V_marked")
def _(fx):
    return fx.dealt.V_marked.select("doc_id", T.speak_ratios("text").alias("text"))


@query("FN7_signs", f"select doc_id, {sql_signs('text')} as text from V_marked")
def _(fx):
    return fx.dealt.V_marked.select("doc_id", T.speak_signs("text").alias("text"))


@query("FN8_numbers_to_words", f"select doc_id, {sql_numbers('text')} as text from V_marked")
def _(fx):
    return fx.dealt.V_marked.select("doc_id", numbers_to_words("text").alias("text"))


_CLEAN = f"regexp_replace({CHARS}, '\\s+,', ',', 'g')"


def speech_sql(texts: str) -> str:
    """The full cleaning of a table (doc_id, text) without speaker tags, as a chain that ends in ``u``."""
    return f"""a as (select x.doc_id, d.source, {_CLEAN.replace("text", "x.text")} as text from {texts} x join documents d on d.doc_id = x.doc_id),
        w as (select a.doc_id, case when c.has_words then {sql_words('a.text', {'the': 'THE', 'que': 'Q$1'}, False)} else a.text end as text from a left join V_config c on c.series = a.source),
        c2 as (select doc_id, regexp_replace({sql_acronyms('text')}, '\\[([^\\]\\n]*)\\]', '\\1', 'g') as text from w),
        e as (select doc_id, regexp_replace(text, '([0-9]+)\\s*/\\s*([0-9]+)', '\\1 out of \\2', 'g') as text from c2),
        f as (select doc_id, {sql_signs('text')} as text from e),
        u as (select doc_id, {sql_numbers('text')} as text from f)"""


@query(
    "FN15_clean_for_speech",
    f"""with a as (select doc_id, source, {_CLEAN} as text from V_marked),
        b as (select a.doc_id, case when c.has_words then {sql_words('a.text', {'the': 'THE', 'que': 'Q$1'}, False)} else a.text end as text from a join V_config c on c.series = a.source),
        c2 as (select doc_id, regexp_replace({sql_acronyms('text')}, '\\[([^\\]\\n]*)\\]', '\\1', 'g') as text from b),
        e as (select doc_id, regexp_replace(text, '([0-9]+)\\s*/\\s*([0-9]+)', '\\1 out of \\2', 'g') as text from c2),
        f as (select doc_id, {sql_signs('text')} as text from e)
        select doc_id, {sql_numbers('text')} as text from f""",
)
def _(fx):
    return with_config(fx, fx.dealt.V_marked).select("doc_id", T.clean_for_speech("text", "words").alias("text"))


#: documents cleaned without a series' own words, as a chain that ends in ``d``
_SPOKEN = f"regexp_replace({CHARS}, '\\s+,', ',', 'g')"
CLEANED = f"""a as (select doc_id, source, {_SPOKEN} as text from documents), b as (select doc_id, source, regexp_replace({sql_acronyms('text')}, '\\[([^\\]\\n]*)\\]', '\\1', 'g') as text from a),
        c as (select doc_id, source, {sql_signs("regexp_replace(text, '([0-9]+)\\s*/\\s*([0-9]+)', '\\1 out of \\2', 'g')")} as text from b),
        d as (select doc_id, source, {sql_numbers('text')} as text from c)"""

_TITLE = nested("title", fixed.TITLE_CHARACTERS)


@query("FN10_title_characters", f"with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) select page_id, {_TITLE} as title from t")
def _(fx):
    return fx.pages.select("page_id", N.plain_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


_KEY = f"trim(regexp_replace(regexp_replace(lower({_TITLE}), '[^{WORD}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query("FN9_title_key", f"with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages) select page_id, {_KEY} as title_key from t")
def _(fx):
    return fx.pages.select("page_id", N.title_key(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title_key"))


_DRESS = """case id % 5 when 0 then concat(title, ' | Royal Road') when 1 then concat(series, ' ', title, ' | Royal Road')
            when 2 then concat('Chapter ', cast(id as string), ' - Part - (Book 3) ', upper(series), ' [tags] Royal Road') when 3 then concat(title, ' - ', title) else 'Chapter - Rest' end"""


@query(
    "FN11_strip_series",
    f"""with t as (select id, series, {_DRESS} as title from V_chapters),
        a as (select id, series, case when contains(title, ' | Royal Road') then trim(split_part(title, ' | Royal Road', 1)) when ends_with(title, ' Royal Road') then trim(title[:-12]) else title end as t1 from t),
        b as (select id, series, regexp_replace(t1, '\\s*\\[[^\\]]*\\]\\s*$', '') as t2 from a),
        p as (select *, string_split(t2, ' - ') as w from b),
        s as (select *, list_max(list_filter(range(1, len(w)), lambda k: contains(lower(array_to_string(w[k + 1:], ' - ')), series))) as cut from p),
        c as (select id, series, case when cut is not null then trim(array_to_string(w[:cut], ' - ')) else t2 end as t3 from s)
        select id, case when starts_with(lower(t3), series) and trim(substr(t3, length(series) + 1)) <> '' then trim(substr(t3, length(series) + 1)) else t3 end as title from c""",
)
def _(fx):
    rows = fx.sql(f"select id, series, {_DRESS} as title from V_chapters")
    return rows.select("id", N.strip_series("title", "series").alias("title"))


@query(
    "FN12_title_repairs",
    """select id, concat('Chapter ', n, ' - ', series, ' p', id) as old_title, concat('Chapter ', n) as new_title
       from (select id, series, cast(id % 50 as string) as n from V_chapters) t""",
)
def _(fx):
    return title_fixes(fx.V_chapters).select("id", "old_title", "new_title")


# documents whose lines hold messages with doubled spaces, a space before a comma, and one message around another
MESSY = """select doc_id, concat(text,
  case doc_id % 5 when 0 then concat(chr(10), '  Stolen   from its author , report  it.  ') when 1 then concat(chr(10), 'Stolen SPAMfrom its author, report it. Rest ', cast(doc_id as string))
    when 2 then concat(chr(10), 'SPAM', chr(9), ' x', chr(10), 'a SP SPAM AM b') when 3 then concat(chr(10), 'SP SPAM AM') else '' end) as text from documents"""
MESSAGES = "select item_id, message from V_block union all select -3, 'SPAM' union all select -2, 'Stolen from its author, report it.' union all select -1, 'AM b'"


def paragraph_sql(collapse: bool, dedupe: bool) -> str:
    tidy = "trim(regexp_replace({}, '\\s+', ' ', 'g'))" if collapse else SQL_STRIP
    norm = f"regexp_replace({tidy.format('line')}, ' ([,.!?;:\'\'\"])', '\\1', 'g')" if collapse else tidy.format("line")
    keep = "where changed or rn = 1" if dedupe else ""
    return f"""with b as ({MESSAGES}), d as ({MESSY}),
        v as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from d)),
        m as (select list(message order by item_id) as ms from b),
        n as (select doc_id, pos, {norm} as raw from v),
        c as (select doc_id, pos, raw, list_reduce(list_prepend(raw, ms), lambda a, x: case when contains(a, x) then {tidy.format("replace(a, x, '')")} else a end) as line
              from n, m where raw <> '' and not list_contains(ms, raw)),
        r as (select doc_id, pos, line, line <> raw as changed, row_number() over (partition by doc_id, line order by pos) as rn from c where line <> '')
        select doc_id, pos, line from r {keep}"""


def _paragraphs(fx, collapse, dedupe, **kw):
    docs = clean_documents(fx.dealt.sql(MESSY), fx.sql(MESSAGES), collapse, dedupe, **kw)
    rows = explode_rows(docs, F.col("paragraphs"), "p", "doc_id")
    return rows.select("doc_id", F.col("p.pos").cast("bigint").alias("pos"), "p.line")


@query("FN13_boilerplate", paragraph_sql(True, False))
def _(fx):
    return _paragraphs(fx, True, False)


@query("FN13_boilerplate_second_site", paragraph_sql(False, False))
def _(fx):
    return _paragraphs(fx, False, False)


@query("WN2_repeated_paragraphs", paragraph_sql(True, True))
def _(fx):
    return _paragraphs(fx, True, True)


@query("JN12_paragraphs_long_list", paragraph_sql(True, True))
def _(fx):
    """The same with the list treated as too long for a literal."""
    return _paragraphs(fx, True, True, max_rows=0)


@query("FN14_space_before_punctuation", "select doc_id, pos, regexp_replace(replace(line, ',', ' ,'), ' ([,.!?;:''\"])', '\\1', 'g') as line from V_lines")
def _(fx):
    return fx.V_lines.select("doc_id", "pos", T.tighten_punctuation(F.replace("line", F.lit(","), F.lit(" ,"))).alias("line"))


@query(
    "JN12_blocklist",
    f"""with m as (select list(text order by item_id) as ms from benchmark)
        select doc_id, list_reduce(list_prepend(text, ms), lambda a, x: case when contains(a, x) then {SQL_STRIP.format("replace(a, x, '')")} else a end) as text from documents, m""",
)
def _(fx):
    block = fx.benchmark.select("item_id", F.col("text").alias("message"))
    docs = attach_messages(fx.dealt.documents, block)
    return docs.select("doc_id", T.cut_messages(F.col("text"), F.col("messages"), collapse_spaces=False).alias("text"))


@query("JN12_blocklist_long_list", "select d.doc_id, count(*) as hits from documents d join V_block b on contains(d.text, b.message) group by d.doc_id")
def _(fx):
    """The same list treated as too long to broadcast: matched by a join on anchor words."""
    found = anchored_matches(fx.dealt.documents, fx.V_block, "text", "doc_id", "message", "item_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "PRJ4_source_name",
    """select url, case when lower(trim(url)) = 'local' then 'local' when contains(lower(regexp_extract(url, '//([^/?#]*)', 1)), 'royalroad.com') then 'royalroad'
       when contains(lower(regexp_extract(url, '//([^/?#]*)', 1)), 'scribblehub.com') then 'scribblehub' end as source from (select url from V_series union all select url from pages) u""",
)
def _(fx):
    return fx.V_series.select("url").unionAll(fx.pages.select("url")).select("url", N.source_name("url").alias("source"))


@query("PRJ5_normal_url", "select page_id, split_part(rtrim(url, '/'), '?', 1) as norm from pages")
def _(fx):
    return fx.pages.select("page_id", N.normal_url("url").alias("norm"))


@query("PRJ6_index_from_url", "select url, cast(nullif(regexp_extract(url, '/chapter/([0-9]+)', 1), '') as bigint) as idx from (select url from V_links union all select url from pages) u")
def _(fx):
    return fx.V_links.select("url").unionAll(fx.pages.select("url")).select("url", N.index_from_url("url").alias("idx"))


@query(
    "PRJ7_publication_date",
    """select event_id, case when event_id % 4 = 0 then 'unknown_date' else strftime(ts, '%Y-%m-%d') end as day from events""",
)
def _(fx):
    stamp = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'-11:00'"))
    return fx.events.select("event_id", N.publication_date(stamp).alias("day"))


@query("SRC3_decode_file_name", "select id, published_date, concat('Chapter ', id % 50, ' - ', series, ' p', id) as title from V_chapters")
def _(fx):
    from ..operators.state import base_name

    parts = N.decode_file_name(base_name(F.col("raw_path")))
    return fx.V_chapters.select("id", parts["published_date"].alias("published_date"), parts["title"].alias("title"))


@query("SRC4_encode_file_name", "select page_id, concat('2024-01-01_', regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\\\\/:*?\"<>|]', '', 'g'), '.txt') as file_name from pages")
def _(fx):
    return fx.pages.select("page_id", N.encode_file_name(F.lit("2024-01-01"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("file_name"))


@query("SRC2_pages", "select page_id, url, length(html) as chars from pages")
def _(fx):
    return fx.pages.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


NATURAL = """array_to_string(list_transform(regexp_extract_all(title, '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]')
         then lpad(cast(length(ltrim(x, '0')) as varchar), 5, '0') || ltrim(x, '0') else lower(x) end), '')"""


@query(
    "OR2_natural_order",
    f"select id, sort_text, row_number() over (order by sort_text, id) as rank from (select id, {NATURAL} as sort_text from V_chapters)",
)
def _(fx):
    rows = fx.V_chapters.select("id", "title").orderBy(N.natural_key("title"), "id")
    return in_order(rows.select("id", N.natural_text("title").alias("sort_text")))


@query(
    "OR3_collated_order",
    f"with a as (select id, case id % 3 when 0 then replace(title, 'a', 'á') when 1 then upper(title) else title end as title from V_chapters) select id, row_number() over (order by strip_accents({NATURAL}), id) as rank from a",
)
def _(fx):
    """Titles with accents and capitals, which take their place among the plain ones."""
    shown = F.expr("case id % 3 when 0 then replace(title, 'a', 'á') when 1 then upper(title) else title end")
    rows = fx.V_chapters.select("id", shown.alias("title")).orderBy(N.collated_key("title"), "id")
    return in_order(rows.select("id"))


@query(
    "FN16_decode_audit",
    "select doc_id, regexp_matches(text, '[^\\x00-\\x7F]') as invalid, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as bad_bytes from documents",
)
def _(fx):
    from ..sources.files import audit_encoding

    raw = fx.documents.select("doc_id", F.encode("text", "ISO-8859-1").alias("content"))
    return audit_encoding(raw).select("doc_id", "invalid", F.col("bad_bytes").cast("bigint").alias("bad_bytes"))


@query(
    "FN16_undecodable_bytes",
    r"""with d as (select doc_id, coalesce(text, '') as t, octet_length(encode(coalesce(text, ''))) as n from documents),
        e as (select doc_id, t, n, case doc_id % 4
            when 0 then [{'o': n, 'b': 255}, {'o': n + 3, 'b': 195}]
            when 1 then list_transform(list_filter(range(1, length(t) + 1), lambda i: unicode(t[i]) > 127), lambda i: {'o': i - 1, 'b': unicode(t[i])})
            when 2 then []
            else list_concat([{'o': 0, 'b': 237}, {'o': 1, 'b': 160}, {'o': 2, 'b': 128}], [{'o': n + 3, 'b': 244}, {'o': n + 4, 'b': 144}, {'o': n + 5, 'b': 128}, {'o': n + 6, 'b': 128}]) end as l from d)
        select doc_id, u.o::bigint as "offset", u.b::int as byte from (select doc_id, unnest(l) as u from e)""",
)
def _(fx):
    """A lone byte and a cut character behind the text, one-byte characters, nothing, a surrogate and a value beyond the last character."""
    from ..sources.files import undecodable

    plain = "encode(coalesce(text, ''), 'UTF-8')"
    content = F.expr(f"""case doc_id % 4 when 0 then concat({plain}, X'FF', encode('é', 'UTF-8'), X'C3')
        when 1 then encode(coalesce(text, ''), 'ISO-8859-1') when 2 then {plain}
        else concat(X'EDA080', {plain}, X'F4908080') end""")
    rows = explode_rows(fx.dealt.documents.select("doc_id", content.alias("content")), undecodable("content"), "u", "doc_id")
    return rows.select("doc_id", "u.offset", "u.byte")
