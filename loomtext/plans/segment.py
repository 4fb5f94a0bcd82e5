"""Voice parts, chunks and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..functions.base import explode_rows, posexplode_rows
from ..operators import segment as S
from ..operators import sentences as Y
from ..operators.boilerplate import clean_documents
from ..session import broadcast_if_small, cut_lineage
from .registry import query
from .text import SQL_STRIP, speech_sql, with_config

BLOCK = "(?s)<<SPEAKER=[^>]+>>.*?<</SPEAKER>>"
_INNER = "regexp_extract(p, '(?s)^<<SPEAKER=[^>]+>>(.*)<</SPEAKER>>$', 1)"
_SPEAKER = "regexp_extract(p, '^<<SPEAKER=([^>]+)>>', 1)"

# ordered parts: gaps and blocks interleaved, blank ones dropped, then numbered
PARTS = f"""gaps as (select conv_id, string_split_regex(text, '{BLOCK}') as g, regexp_extract_all(text, '{BLOCK}') as b from V_tagged),
    woven as (select conv_id, flatten(list_transform(range(1, len(g) + 1), lambda i: case when i <= len(b) then [g[i], b[i]] else [g[i]] end)) as ps from gaps),
    kept as (select conv_id, list_filter(ps, lambda p: regexp_matches(p, '\\S') and p <> '<<') as ps from woven),
    parts as (select conv_id, unnest(range(len(ps))) as part_pos, unnest(ps) as p from kept),
    named as (select conv_id, part_pos, starts_with(p, '<<SPEAKER=') as tagged,
        case when starts_with(p, '<<SPEAKER=') then {_SPEAKER} end as speaker, case when starts_with(p, '<<SPEAKER=') then {_INNER} else p end as content from parts)"""


def _parts(fx):
    rows = explode_rows(fx.V_tagged, T.parts_of("text"), "p", "conv_id")
    return rows.select("conv_id", F.col("p.part_pos").cast("bigint").alias("part_pos"), "p.tagged", "p.speaker", "p.content")


@query("SEG1_parts", f"with {PARTS} select conv_id, part_pos, tagged, content from named")
def _(fx):
    return _parts(fx).select("conv_id", "part_pos", "tagged", "content")


@query(
    "WN1_merge_speaker_blocks",
    f"""with {PARTS},
        cleaned as (select *, case when tagged then {SQL_STRIP.format("content")} else content end as body, lag(case when tagged then speaker end) over (partition by conv_id order by part_pos) as before from named),
        islands as (select *, sum(case when tagged and before is not distinct from speaker then 0 else 1 end) over (partition by conv_id order by part_pos) as island from cleaned),
        merged as (select conv_id, island, bool_or(tagged) as tagged, min(speaker) as speaker, string_agg(body, chr(10) order by part_pos) as body from islands group by conv_id, island)
        select conv_id, cast(island as bigint) as block, tagged, speaker, body from merged""",
)
def _(fx):
    merged = fx.V_tagged.select("conv_id", T.merge_speaker_blocks("text").alias("text"))
    rows = explode_rows(merged, T.parts_of("text"), "p", "conv_id")
    return rows.select("conv_id", (F.col("p.part_pos") + 1).cast("bigint").alias("block"), "p.tagged", "p.speaker", F.col("p.content").alias("body"))


_NAME = "case when tagged and speaker <> 'default' then lower(speaker) else narrator end"
_VOICE = """case when known.voice_name is null and name = 'user' then map_user when known.voice_name is null and name = 'assistant' then map_assistant else name end"""
VOICED = f"""{PARTS},
    conf as (select n.conv_id, n.part_pos, n.content, c.map_user, c.map_assistant, c.system_voice, {_NAME} as raw_name from named n join V_config c on c.id = n.conv_id % 20),
    sys as (select *, raw_name = 'system' as is_system, case when raw_name = 'system' then system_voice else raw_name end as name from conf),
    voiced as (select conv_id, part_pos, is_system, content, {_VOICE} as voice from sys left join V_voices known on known.voice_name = sys.name)"""


def tagged_with_config(fx):
    """Tagged texts with the settings of the series they stand for."""
    docs = fx.V_tagged.withColumn("series_id", F.col("conv_id") % 20)
    config = fx.V_config.select(
        F.col("id").alias("series_id"), "narrator", "system_voice",
        F.create_map(F.lit("user"), "map_user", F.lit("assistant"), "map_assistant").alias("mappings"),
    )
    return docs.join(broadcast_if_small(config), "series_id")


def tagged_chunks(fx):
    docs = tagged_with_config(fx)
    chunks = S.chunk_manifest(docs, F.col("narrator"), F.col("system_voice"), keep=("conv_id", "mappings"))
    return S.resolve_voice(chunks, fx.V_voices, F.col("mappings"))


@query("SEG2_part_voices", f"with {VOICED} select conv_id, part_pos, is_system, content, voice from voiced")
def _(fx):
    docs = tagged_with_config(fx)
    rows = explode_rows(docs, T.parts_of("text"), "p", "conv_id", "narrator", "system_voice", "mappings")
    name = F.when(F.col("p.tagged") & (F.col("p.speaker") != "default"), F.lower("p.speaker")).otherwise(F.col("narrator"))
    rows = rows.select("conv_id", F.col("p.part_pos").cast("bigint").alias("part_pos"), "p.content", "system_voice", "mappings", name.alias("name"))
    rows = rows.withColumn("is_system", F.col("name") == "system").withColumn("speaker", F.when(F.col("is_system"), F.col("system_voice")).otherwise(F.col("name")))
    return S.resolve_voice(rows, fx.V_voices, F.col("mappings")).select("conv_id", "part_pos", "is_system", "content", "voice")


@query("JN11_voice_resolution", f"with {VOICED} select voice, is_system, count(*) as parts from voiced group by voice, is_system")
def _(fx):
    chunks = tagged_chunks(fx)
    return chunks.groupBy("voice", "is_system").agg(F.count_distinct("conv_id", "part_pos").alias("parts"))


# sentences, then a fold that keeps the chunks made so far and the open one in a text split by char 2
def sql_pack(text: str, limit: int) -> str:
    cut = f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda q: {SQL_STRIP.format('q')}), lambda q: q <> '')"
    last = "split_part(a, chr(2), -1)"
    words = "list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')"
    word_last = "split_part(v, chr(2), -1)"
    hard = (
        f"list_reduce(list_prepend('', {words}), lambda v, w: case when (case when {word_last} = '' then 0 else length({word_last}) + 1 end) + length(w) + 1 > {limit} "
        f"then v || chr(2) || w when {word_last} = '' then v || w else v || ' ' || w end)"
    )
    step = (
        f"case when length(s) > {limit} then a || (case when {last} = '' then '' else chr(2) end) || {hard} || chr(2) "
        f"when {last} = '' then a || s when length({last}) + 2 + length(s) <= {limit} then a || chr(10) || chr(10) || s else a || chr(2) || s end"
    )
    folded = f"list_reduce(list_prepend('', {cut}), lambda a, s: {step})"
    return f"list_transform([string_split({folded}, chr(2))], lambda c: case when c[-1] = '' then c[:-2] else c end)[1]"


@query(
    "SEG3_sentences",
    f"""with q as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda q: {SQL_STRIP.format('q')}), lambda q: q <> '') as ss from documents)
        select doc_id, unnest(range(len(ss))) as pos, unnest(ss) as sentence from q""",
)
def _(fx):
    rows = posexplode_rows(fx.dealt.documents, S.sentences("text"), "pos", "sentence", "doc_id")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


# texts with titles, initials, inner full stops, numbers and quotes at their ends
SPOKEN = """select doc_id, concat(text, chr(10), case doc_id % 4
    when 0 then 'Dr. Ash met Mr. Elm, e.g. at St. Ives. The J. R. Oak tree fell... and lay there. He left.'
    when 1 then concat('They saw Dr. Ash at No. ', cast(doc_id as string), ' on p. 3. it said "Stop!" He went to Mr. Elm. Then Dr. The end came.')
    when 2 then 'It was (see e.g. Mr. Elm) late... The bell rang at 5 p.m. He slept. Mr. Elm ate 12. Five came.'
    else 'No sir. She and St. Paul, i.e. he, left? Yes. They met Dr. Ash (at 10 a.m.) by St. Ives.' end) as text from documents"""

_TYPE = r"""lower(regexp_replace(regexp_replace(regexp_replace({0}, '^["''(\[{{“‘]+', ''), '["'')\]}}”’,;:!?]+$', ''), '\.$', ''))"""
_END = r"""regexp_replace(regexp_replace({0}, '^["''(\[{{“‘]+', ''), '["'')\]}}”’]+$', '')"""
_LNP = "case when {1} > 0 then {1} * ln({0}) else 0 end"
LEARNT = rf"""sp as ({SPOKEN}),
    tk as (select doc_id, unnest(range(len(l))) as pos, unnest(l) as t from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as l from sp)),
    ty as (select *, {_TYPE.format('t')} as ty, ends_with(regexp_replace(regexp_replace(t, '^["''(\[{{“‘]+', ''), '["'')\]}}”’,;:!?]+$', ''), '.') as dot, {_END.format('t')} as e from tk),
    co as (select ty, count(*) as n, count(*) filter (where dot) as k from ty group by ty), su as (select sum(n)::double as n, sum(k)::double as k from co),
    sc as (select ty, co.n, co.k, length(replace(ty, '.', ''))::double as l, least(1.0, 1000.0 / co.n) * co.k as y, least(1.0, 1000.0 / co.n) * (co.n - co.k) as o, su.k / su.n as p from co, su
           where co.k > 0 and regexp_matches(ty, '^\p{{L}}[\p{{L}}\p{{M}}]*(\.\p{{L}}[\p{{L}}\p{{M}}]*)*$')),
    ab as (select ty, n, k, 2 * (y * ln(0.99) + o * ln(1 - 0.99) - y * ln(p) - o * ln(1 - p)) * exp(-l) * (length(ty) - l + 1) * pow(l, -o) as score from sc),
    al as (select list(ty) as l from ab where score >= 0.3),
    ki as (select ty.*, case when regexp_matches(e, '[!?]$') then 'end' when ends_with(e, '..') then 'dots' when not ends_with(e, '.') then ''
             when list_contains(al.l, ty) or regexp_matches(ty, '^\p{{L}}$') then 'short' when regexp_matches(ty, '^[-+]?[0-9]+([.,][0-9]+)*$') then 'number' else 'end' end as kind from ty, al),
    nx as (select *, lead(ty) over w as nty, lead(t) over w as nt from ki window w as (partition by doc_id order by pos)),
    af as (select nty as ty, count(*) as a from nx where kind = 'end' and nt is not null group by nty), br as (select sum(a)::double as b, least(1.0, 1000000 / any_value(su.n)) as f from af, su),
    st as (select af.ty, co.n, af.a, a * f as ab, co.n * f as cb, b * f as ca, su.n * f as nn from af join co on co.ty = af.ty, br, su where regexp_matches(af.ty, '^\p{{L}}+$') and a * su.n > co.n * b),
    ss as (select ty, n, a, 2 * ({_LNP.format('ab / ca', 'ab')} + {_LNP.format('1 - ab / ca', '(ca - ab)')} + {_LNP.format('(cb - ab) / (nn - ca)', '(cb - ab)')} + {_LNP.format('1 - (cb - ab) / (nn - ca)', '(nn - ca - cb + ab)')}
             - {_LNP.format('cb / nn', 'ab')} - {_LNP.format('1 - cb / nn', '(ca - ab)')} - {_LNP.format('cb / nn', '(cb - ab)')} - {_LNP.format('1 - cb / nn', '(nn - ca - cb + ab)')}) as score from st),
    sl as (select list(ty) as l from ss where score >= 30)"""


@query("SEG3_abbreviations", f"with {LEARNT} select ty as type, n::bigint as n, k::bigint as stopped, round(score, 6) as score from ab where score >= 0.3")
def _(fx):
    found = Y.abbreviation_scores(cut_lineage(Y.count_types(fx.dealt.sql(SPOKEN)))).where(F.col("score") >= Y.LEAST_SCORE)
    return found.select("type", "n", "stopped", F.round("score", 6).alias("score"))


@query("SEG3_starters", f"with {LEARNT} select ty as type, n::bigint as n, a::bigint as after, round(score, 4) as score from ss where score >= 30")
def _(fx):
    texts = fx.dealt.sql(SPOKEN)
    types = cut_lineage(Y.count_types(texts))
    short = [r.type for r in Y.abbreviation_scores(types).where(F.col("score") >= Y.LEAST_SCORE).select("type").collect()]
    found = Y.starter_scores(texts, types, short).where(F.col("score") >= Y.LEAST_RATIO)
    return found.select("type", "n", "after", F.round("score", 4).alias("score"))


@query(
    "SEG3_learnt_sentences",
    rf"""with {LEARNT}, hd as (select *, regexp_replace(coalesce(nt, ''), '^["''(\[{{“‘]+', '') as h from nx, sl),
        fl as (select doc_id, pos, t, kind = 'end' or (kind = 'short' and regexp_matches(h, '^\p{{Lu}}') and list_contains(l, nty)) or (kind = 'number' and not regexp_matches(h, '^\p{{Ll}}')) or (kind = 'dots' and regexp_matches(h, '^\p{{Lu}}')) as brk from hd),
        gr as (select doc_id, pos, t, coalesce(sum(brk::int) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as no from fl)
        select doc_id, no::bigint as pos, string_agg(t, ' ' order by pos) as sentence from gr group by doc_id, no""",
)
def _(fx):
    texts = fx.dealt.sql(SPOKEN)
    model = Y.learn_sentences(texts)
    rows = posexplode_rows(texts, Y.split_sentences("text", model), "pos", "sentence", "doc_id")
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.regexp_replace("sentence", r"\s+", " ").alias("sentence"))


def _packed(fx, limit):
    rows = posexplode_rows(fx.dealt.documents, S.pack("text", limit), "idx", "chunk", "doc_id")
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "chunk")


@query("WN6_pack_chunks", f"with c as (select doc_id, {sql_pack('text', fixed.CHUNK_CHARS_LARGE)} as cs from documents) select doc_id, unnest(range(len(cs))) as idx, unnest(cs) as chunk from c")
def _(fx):
    return _packed(fx, fixed.CHUNK_CHARS_LARGE)


@query("WN6_pack_small_chunks", f"with c as (select doc_id, {sql_pack('text', fixed.CHUNK_CHARS_SMALL)} as cs from documents) select doc_id, unnest(range(len(cs))) as idx, unnest(cs) as chunk from c")
def _(fx):
    return _packed(fx, fixed.CHUNK_CHARS_SMALL)


@query("SEG4_hard_split", f"with c as (select doc_id, {sql_pack('text', 40)} as cs from documents) select doc_id, unnest(range(len(cs))) as idx, unnest(cs) as chunk from c")
def _(fx):
    """A limit below most sentences, so nearly every sentence is split at its words."""
    return _packed(fx, 40)


CHUNKED = f"""{VOICED},
    listed as (select conv_id, part_pos, is_system, voice, {sql_pack('content', fixed.CHUNK_CHARS_LARGE)} as cs from voiced),
    chunked as (select conv_id, part_pos, is_system, voice, unnest(range(len(cs))) as chunk_idx, unnest(cs) as chunk from listed),
    manifest as (select conv_id, part_pos, chunk_idx, is_system, voice, trim(trim(chunk, '<>')) as text, length(chunk) as chars from chunked where regexp_matches(chunk, '\\S'))"""

_LONG = ["part_pos", "chunk_idx", "chars"]


def _wide(df):
    return df.withColumns({c: F.col(c).cast("bigint") for c in _LONG})


@query("SEG5_chunk_manifest", f"with {CHUNKED} select conv_id, part_pos, chunk_idx, voice, is_system, text, chars from manifest")
def _(fx):
    return _wide(tagged_chunks(fx)).select("conv_id", "part_pos", "chunk_idx", "voice", "is_system", "text", "chars")


@query("WN10_output_order", f"with {CHUNKED} select conv_id, part_pos, chunk_idx, row_number() over (partition by conv_id order by part_pos, chunk_idx) as place from manifest")
def _(fx):
    from ..operators.ranking import row_number_by

    rows = row_number_by(_wide(tagged_chunks(fx)), ["conv_id"], [F.asc("part_pos"), F.asc("chunk_idx")], [F.expr("part_pos div 65536"), F.col("part_pos"), F.expr("chunk_idx div 4096")], "place")
    return rows.select("conv_id", "part_pos", "chunk_idx", "place").orderBy("conv_id", "part_pos", "chunk_idx")


@query("AG4_content_chars", f"with {PARTS} select conv_id, cast(sum(length(content)) as bigint) as chars from named group by conv_id")
def _(fx):
    return fx.V_tagged.select("conv_id", T.content_chars(T.parts_of("text")).alias("chars"))


@query(
    "AG5_voice_groups",
    f"""with {CHUNKED} select conv_id, voice, min(part_pos) as first_part, arg_min(chunk_idx, part_pos * 1000000 + chunk_idx) as first_chunk, count(*) as chunks, cast(sum(chars) as bigint) as chars from manifest group by conv_id, voice""",
)
def _(fx):
    groups = S.voice_groups(_wide(tagged_chunks(fx)), "conv_id")
    return groups.select("conv_id", "voice", F.col("first.part_pos").alias("first_part"), F.col("first.chunk_idx").alias("first_chunk"), "chunks", "chars")


_RANKED = "ranked as (select *, row_number() over (partition by doc_id, speaker order by length(text) desc, part_pos, chunk_idx) as rank from V_chunks)"


@query("WN3_length_batches", f"with {_RANKED} select doc_id, speaker, part_pos, chunk_idx, rank, (rank - 1) // 5 as batch from ranked")
def _(fx):
    rows = S.length_batches(fx.V_chunks, ["doc_id", "speaker"])
    return rows.select("doc_id", "speaker", "part_pos", "chunk_idx", "rank", "batch")


@query("WN3_length_batches_hot_keys", f"with {_RANKED} select doc_id, speaker, part_pos, chunk_idx, rank, (rank - 1) // 5 as batch from ranked")
def _(fx):
    """Every voice above one row taken as hot, so the bucketed numbering is what is checked."""
    rows = S.length_batches(fx.V_chunks, ["doc_id", "speaker"], hot_rows=1)
    return rows.select("doc_id", "speaker", "part_pos", "chunk_idx", "rank", "batch")


_WORK = "cast(floor(greatest(60.0E0, length(text) * 0.3E0) * 12) as bigint)"


@query("AG6_batch_caps", f"with {_RANKED} select doc_id, speaker, (rank - 1) // 5 as batch, max({_WORK}) as max_work, count(*) as members from ranked group by all")
def _(fx):
    return S.batch_caps(S.length_batches(fx.V_chunks, ["doc_id", "speaker"]), ["doc_id", "speaker"])


@query("FN22_work_estimate", f"select doc_id, chunk_idx, {_WORK} as work from V_chunks")
def _(fx):
    return fx.V_chunks.select("doc_id", "chunk_idx", S.work_estimate(F.length("text")).alias("work"))


_SECONDS = "chars * (0.02E0 + (chunk_idx % 40) * 0.02E0) + 3"


@query(
    "FN21_overlong_chunks",
    f"select doc_id, chunk_idx, round({_SECONDS}, 6) as seconds, round(greatest(15.0E0, chars * 0.3E0), 6) as max_seconds, chunk_idx % 12 < 10 as retry from V_chunks where {_SECONDS} > greatest(15.0E0, chars * 0.3E0)",
)
def _(fx):
    made = fx.V_chunks.withColumn("seconds", F.expr(_SECONDS)).withColumn("attempt", F.col("chunk_idx") % 12)
    rows = S.overlong(made, "seconds", "chars", "attempt")
    return rows.select("doc_id", "chunk_idx", F.round("seconds", 6).alias("seconds"), F.round("max_seconds", 6).alias("max_seconds"), "retry")


def _produced(fx):
    """Chunks whose output is there already: those of documents with a label."""
    return fx.V_chunks.join(fx.labels, "doc_id", "left_semi").select("doc_id", "part_pos", "chunk_idx")


_KEYS = ["doc_id", "part_pos", "chunk_idx"]


@query("SET4_remaining_chunks", "select doc_id, part_pos, chunk_idx, chars from V_chunks c where not exists (select 1 from labels l where l.doc_id = c.doc_id)")
def _(fx):
    return S.remaining(fx.V_chunks, _produced(fx), _KEYS).select(*_KEYS, "chars")


@query(
    "SEG6_progress_chars",
    "select c.doc_id, cast(sum(case when l.doc_id is not null or not regexp_matches(text, '\\S') then chars else 0 end) as bigint) as chars_done, cast(sum(chars) as bigint) as chars_total from V_chunks c left join labels l on l.doc_id = c.doc_id group by c.doc_id",
)
def _(fx):
    return S.progress_chars(fx.V_chunks, _produced(fx), _KEYS)


_SETTING = "case when s.speaker = 'voice0' then 0.5E0 when s.speaker = 'voice1' then null else 0.2E0 end"


@query("PRJ10_narrator_setting", f"select doc_id, chunk_idx, {_SETTING} as pause, case when s.speaker = 'voice1' then 2.0E0 else 1.0E0 end as volume from V_chunks s")
def _(fx):
    one = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v).cast("double"))])
    settings = F.create_map(
        F.lit("voice0"), one(pause=0.5), F.lit("voice1"), one(pause=None, volume=2.0), F.lit("default"), one(pause=0.2)
    )
    pick = lambda f, x: S.narrator_setting(settings, F.col("speaker"), f, F.lit(x).cast("double"))
    return fx.V_chunks.select("doc_id", "chunk_idx", pick("pause", None).alias("pause"), pick("volume", 1.0).alias("volume"))


_PARA = f"""m as (select list(message order by item_id) as ms from V_block),
    n as (select doc_id, pos, regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ([,.!?;:''"])', '\\1', 'g') as raw from V_lines),
    c as (select doc_id, pos, raw, list_reduce(list_prepend(raw, ms), lambda a, x: case when contains(a, x) then trim(regexp_replace(replace(a, x, ''), '\\s+', ' ', 'g')) else a end) as line from n, m where raw <> '' and not list_contains(ms, raw)),
    r as (select doc_id, pos, line, line <> raw as changed, row_number() over (partition by doc_id, line order by pos) as rn from c where line <> ''),
    j as (select doc_id, string_agg(line, chr(10) order by pos) as text from r where changed or rn = 1 group by doc_id),
    {speech_sql("j")},
    k as (select doc_id, unnest({sql_pack('text', fixed.CHUNK_CHARS_LARGE)}) as chunk from u)"""


def speech_chunks(fx):
    """Documents to packed speech chunks, all in the document's own row and without Python workers."""
    docs = clean_documents(fx.dealt.documents, fx.V_block)
    text = docs.select("doc_id", "source", F.col("clean_text").alias("t"))
    text = with_config(fx, text).withColumn("t", T.clean_for_speech("t", "words"))
    return posexplode_rows(text, S.pack("t"), "idx", "chunk", "doc_id", "source")


@query(
    "flagship_speech_chunks",
    f"with {_PARA} select d.source, count(*) as chunks, count(distinct k.doc_id) as docs, cast(sum(length(chunk)) as bigint) as chars, max(length(chunk)) as longest from k join documents d on d.doc_id = k.doc_id where regexp_matches(chunk, '\\S') group by d.source",
)
def _(fx):
    chunks = speech_chunks(fx).where(F.col("chunk") != "")
    per_doc = chunks.groupBy("source", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("chunk").cast("bigint")).alias("c"), F.max(F.length("chunk")).cast("bigint").alias("longest")
    )
    return per_doc.groupBy("source").agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("docs"), F.sum("c").alias("chars"), F.max("longest").alias("longest")
    )
