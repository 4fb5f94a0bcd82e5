"""Sources and sinks of the streams: files in, one folder per micro-batch out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path


def read_files(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream. ``name`` is a pattern of file names, or that of a table that is a folder of files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    table = f"{folder.rstrip('/')}/{name}"
    # the filter looks at the names of files only
    return reader.parquet(table) if _exists(spark, f"{table}/*") else reader.option("pathGlobFilter", name).parquet(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern leads anywhere; no file is opened."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def event_time(events: DataFrame, name: str = "ts") -> DataFrame:
    """A watermark needs a timestamp with a zone; stored stamps are UTC."""
    return events.withColumn(name, F.col(name).cast("timestamp"))


def run_to_end(
    stream: DataFrame,
    out: str,
    mode: str = "append",
    each: Callable[[DataFrame, int], DataFrame] | None = None,
    checkpoint: str | None = None,
    settings: dict[str, str] | None = None,
) -> None:
    """Process what is there and stop. Each micro-batch overwrites its own folder, so a batch that
    is run again after a failure leaves the same result. ``settings`` hold while the stream runs."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch, batch_id) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint or work_path(spark, "stream"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All micro-batches with their number in ``batch``; no rows before the first."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(numbered).parquet(out) if _exists(spark, out) else spark.createDataFrame([], numbered)


def newest_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the versions that an updating stream wrote, the last one per key."""
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
