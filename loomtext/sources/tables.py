"""State tables with their declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_state(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored snapshot; a column added to the schema later reads as NULL from older files."""
    return spark.read.schema(schema).parquet(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their order and types; missing ones as NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def valid_status(chapters: DataFrame, statuses: list[str]) -> DataFrame:
    return chapters.where(F.col("status").isin(statuses))
