"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """Unsigned CRC-32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def fresh(columns: list[str], name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def positional(df: DataFrame) -> DataFrame:
    """The table with columns c0, c1, ... so that names an operator adds can't clash with its own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, column: str) -> str:
    """The positional name of a column."""
    low = [c.lower() for c in df.columns]
    return f"c{df.columns.index(column) if column in df.columns else low.index(column.lower())}"


#: rows of a batch whose Python objects are held at a time
SLICE = 1_000


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to one batch or None, called on slices of what comes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = run(batch.slice(at, SLICE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(apply, schema)
