"""A corpus pipeline in four stages: language, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, decontaminate, language_mix, near_copies
from loomtext.llm.common import id_crc, place, positional, table
from loomtext.llm.queries import LANGUAGE_FOLDS, LANGUAGE_HELD_OUT, RANKS
from loomtext.session import cut_lineage


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: null texts and texts without a letter go."""
    model = language_mix.learn(docs, id_crc() % LANGUAGE_FOLDS != LANGUAGE_HELD_OUT)
    named = positional(docs)
    found = language_mix.identify(named, model, text=place(docs, "text"))
    return found.where(F.col("lang_pred") != language_mix.NONE).select(*named.columns).toDF(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five words and a similarity of 0.8: the smallest doc_id.

    SimHashes linked by the pigeonring, then wider ones by sampled bits, then a complete join of
    the sets that finds what these miss; whole shingle sets decide on all."""
    return near_copies.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of the benchmark."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with their number, and whether decoding gives the text back."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    kept = docs.select("doc_id", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    # written between, so that a task runs one Python worker at a time and not two
    encoded = cut_lineage(bpe.encode(kept, path, pattern))
    back = bpe.decode(encoded, path, pattern)
    return back.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.sha2("decoded", 256) == F.col("sha")).alias("exact"),
    )


STAGES = [
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: the language model is fitted, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
