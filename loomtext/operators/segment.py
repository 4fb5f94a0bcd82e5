"""Voice segmentation: sentences, size-limited chunks, voices, batches and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.base import col, explode_rows, is_blank, let, posexplode_rows, strip
from ..functions.text import parts_of
from ..session import collect_bounded
from .ranking import row_number_by

_STEP = 256


def sentences(text: Column | str) -> Column:
    """Sentences by end mark and white space: an approximation of a trained splitter."""
    return F.filter(
        F.transform(F.split(col(text), r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != ""
    )


def _packed(items: Column, start: Column, step, finish) -> Column:
    """A fold that appends to a list, in two levels.

    Appending copies the list, so one long fold is quadratic. Here a fold over at most 256
    items fills a short list, and the outer fold keeps these lists and joins them once.
    """
    blocks = F.when(
        F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), F.lit(_STEP)), lambda i: F.slice(items, i, _STEP))
    ).otherwise(F.array().cast("array<array<string>>"))
    empty = F.array().cast("array<string>")

    def outer(acc, block):
        inner = F.aggregate(block, F.struct(empty.alias("out"), acc["buf"].alias("buf")), step)
        return let(inner, lambda r: F.struct(F.concat(acc["out"], F.array(r["out"])).alias("out"), r["buf"].alias("buf")))

    zero = F.struct(F.array().cast("array<array<string>>").alias("out"), start.alias("buf"))
    return F.aggregate(blocks, zero, outer, lambda acc: F.concat(F.flatten(acc["out"]), finish(acc["buf"])))


def _tail(buf: Column) -> Column:
    return F.when(buf != "", F.array(strip(buf))).otherwise(F.array().cast("array<string>"))


def split_words(sentence: Column, limit: int) -> Column:
    """Hard split of a sentence at words; a single word over the limit stays whole."""
    words = F.filter(F.split(sentence, r"(?U)\s+", -1), lambda w: w != "")

    def step(acc, w):
        full = F.length(acc["buf"]) + F.length(w) + 1 > limit
        return F.struct(
            F.when(full, F.concat(acc["out"], F.array(strip(acc["buf"])))).otherwise(acc["out"]).alias("out"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["buf"]), w, F.lit(" ")).alias("buf"),
        )

    return let(words, lambda ws: _packed(ws, F.lit(""), step, _tail))


def pack(text: Column | str, limit: int = fixed.CHUNK_CHARS_LARGE) -> Column:
    """Chunks of at most ``limit`` characters, filled greedily at sentence ends."""

    def step(acc, s):
        fits = (acc["buf"] == "") | (F.length(acc["buf"]) + 2 + F.length(s) <= limit)
        long = F.length(s) > limit
        flushed = F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        joined = F.when(acc["buf"] == "", s).otherwise(F.concat(acc["buf"], F.lit("\n\n"), s))
        return F.struct(
            F.when(long, F.concat(flushed, split_words(s, limit))).when(fits, acc["out"]).otherwise(flushed).alias("out"),
            F.when(long, F.lit("")).when(fits, joined).otherwise(s).alias("buf"),
        )

    return let(sentences(text), lambda ss: _packed(ss, F.lit(""), step, _tail))


def chunk_manifest(
    docs: DataFrame,
    narrator: Column,
    system_voice: Column,
    limit: int = fixed.CHUNK_CHARS_LARGE,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    keep_empty_blocks: bool = False,
) -> DataFrame:
    """One row per chunk in output order; ``speaker`` is the name before mapping to a known voice.

    Parts and chunks come from the document's own row, so nothing is shuffled.
    """
    part = explode_rows(
        docs, parts_of(text, keep_empty_blocks), "p", *keep, narrator.alias("__narrator"), system_voice.alias("__system")
    )
    name = (
        F.when(F.col("p.tagged") & (F.col("p.speaker") != "default"), F.lower("p.speaker"))
        .otherwise(F.col("__narrator"))
    )
    named = part.select(*keep, F.col("p.part_pos").alias("part_pos"), "__system", name.alias("__name"), pack("p.content", limit).alias("__chunks"))
    is_system = F.col("__name") == "system"
    chunk = posexplode_rows(
        named,
        F.col("__chunks"),
        "chunk_idx",
        "__chunk",
        *keep,
        "part_pos",
        F.when(is_system, F.coalesce("__system", F.lit(fixed.DEFAULT_VOICE))).otherwise(F.col("__name")).alias("speaker"),
        F.coalesce(is_system, F.lit(False)).alias("is_system"),
    )
    return chunk.where(~is_blank(F.col("__chunk"))).select(
        *keep,
        "part_pos",
        "chunk_idx",
        "speaker",
        "is_system",
        strip(F.regexp_replace("__chunk", "^[<>]+|[<>]+$", "")).alias("text"),
        F.length("__chunk").alias("chars"),
    )


def resolve_voice(chunks: DataFrame, voices: DataFrame, mappings: Column, name: str = "speaker") -> DataFrame:
    """Add ``voice``: a name that is no known voice goes through the mapping when it has an entry.

    ``voices`` has one column ``voice_name``. A list within the stated size becomes a constant
    set, so a voice with very many chunks is not shuffled; a longer one is joined.
    """
    names = collect_bounded(voices, "voice_name")
    if names is not None:
        marked = chunks.withColumn("__known", F.coalesce(F.col(name).isin(names), F.lit(False)))
    else:
        known = voices.select(F.col("voice_name").alias(name), F.lit(True).alias("__known")).distinct()
        marked = chunks.join(known, name, "left")
    mapped = ~F.coalesce("__known", F.lit(False)) & F.coalesce(F.map_contains_key(mappings, F.col(name)), F.lit(False))
    voice = F.when(mapped, F.element_at(mappings, F.col(name))).otherwise(F.col(name))
    return marked.withColumn("voice", voice).drop("__known")


def voice_groups(chunks: DataFrame, doc: str = "doc_id", voice: str = "voice") -> DataFrame:
    """One row per (document, voice) with its first position; members stay as rows."""
    return chunks.groupBy(doc, voice).agg(
        F.min(F.struct("part_pos", "chunk_idx")).alias("first"),
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.col("chars").cast("bigint")).alias("chars"),
    )


def length_batches(chunks: DataFrame, keys: list[str], size: int = fixed.BATCH_SIZE, hot_rows: int = 1_000_000) -> DataFrame:
    """Batches of chunks of like length: longest first, ties in output order, ``size`` a batch."""
    numbered = row_number_by(
        chunks.withColumn("__len", F.length("text")),
        keys,
        [F.desc("__len"), F.asc("part_pos"), F.asc("chunk_idx")],
        [-F.col("__len"), F.expr("part_pos div 65536"), F.col("part_pos"), F.expr("chunk_idx div 4096")],
        "rank",
        hot_rows,
    )
    return numbered.withColumn("batch", F.expr(f"(rank - 1) div {size}")).drop("__len")


def batch_caps(batches: DataFrame, keys: list[str]) -> DataFrame:
    return batches.groupBy(*keys, "batch").agg(
        F.max(work_estimate(F.length("text"))).alias("max_work"), F.count(F.lit(1)).alias("members")
    )


def max_seconds(chars: Column) -> Column:
    return F.greatest(F.lit(fixed.MIN_CHUNK_SECONDS), chars * F.lit(fixed.SECONDS_PER_CHAR))


def work_estimate(chars: Column) -> Column:
    seconds = F.greatest(F.lit(fixed.MIN_WORK_SECONDS), chars * F.lit(fixed.SECONDS_PER_CHAR))
    return F.floor(seconds * fixed.CODEC_FRAMES_PER_SECOND).cast("bigint")


def narrator_setting(settings: Column, name: Column, field: str, fallback: Column) -> Column:
    """Setting of a narrator: its own entry, then 'default', then the fallback.

    A field that is present wins even when it holds NULL, so presence is what is tested.
    ``settings`` is map<string, map<string, T>>.
    """

    def present(key):
        return F.coalesce(F.map_contains_key(F.element_at(settings, key), F.lit(field)), F.lit(False))

    default = F.lit("default")
    return (
        F.when(present(name), F.element_at(F.element_at(settings, name), F.lit(field)))
        .when(present(default), F.element_at(F.element_at(settings, default), F.lit(field)))
        .otherwise(fallback)
    )


def overlong(chunks: DataFrame, seconds: str, chars: str, attempt: str) -> DataFrame:
    """Chunks longer than plausible; ``retry`` while attempts are left."""
    return chunks.withColumn("max_seconds", max_seconds(F.col(chars))).where(F.col(seconds) > F.col("max_seconds")).withColumn(
        "retry", F.col(attempt) < fixed.MAX_ATTEMPTS
    )


def remaining(planned: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(produced.select(*keys), keys, "left_anti")


def progress_chars(chunks: DataFrame, produced: DataFrame, keys: list[str], doc: str = "doc_id") -> DataFrame:
    """Characters done and in all per document; a chunk counts when produced or blank."""
    marked = chunks.join(produced.select(*keys).distinct().withColumn("__p", F.lit(True)), keys, "left")
    done = F.col("__p").isNotNull() | is_blank(F.col("text"))
    return marked.groupBy(doc).agg(
        F.sum(F.when(done, F.col("chars")).otherwise(0).cast("bigint")).alias("chars_done"),
        F.sum(F.col("chars").cast("bigint")).alias("chars_total"),
    )
