"""Session settings, the shared work folder, lineage cuts and size-checked collection."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "loomtext") -> SparkSession:
    """A UTC session with AQE on. On a cluster pass master=None and keep its own settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = (
            b.master(master)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
        )
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """One process does it all; local-cluster starts executors of its own."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own, which goes when Python ends. A cluster needs the
    setting; that all its machines reach the folder, a mounted ``file:`` path for instance, is for whoever sets it to see to.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="loomtext-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back.

    The rows are computed once (a checkpoint computes them twice), they survive the loss of an
    executor, and counting them afterwards reads file footers only. The folder is cleared with
    the job's other checkpoint data.
    """
    path = work_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect_bounded(df: DataFrame, column: str, max_rows: int = 2_000, max_bytes: int = 1 << 20) -> list[str] | None:
    """Values of a small column in row order, or None when it is over the stated size.

    The size is counted on the executors, so a large table is never pulled to the driver.
    """
    some = df.select(column).limit(max_rows + 1)
    n, b = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    if n > max_rows or b > max_bytes:
        return None
    return [r[0] for r in df.select(column).collect() if r[0] is not None]


#: at most this many splits are dealt out, 1 GiB at Spark's default size of a split
SMALL_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A small file with one row group would otherwise keep costly per-row work on one core. Only scans of at
    most ``SMALL_SPLITS`` splits are dealt, on however many cores; larger ones are split by ``spark.sql.files``.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(min(cores, 8 * splits)) if splits < min(cores, SMALL_SPLITS + 1) else df


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark a side for broadcast only when its counted rows and bytes are within the bounds.

    A larger side is left to the optimizer, which shuffles and splits skewed partitions.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    # a side beyond the bound is not read to its end
    n, b = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and b <= max_bytes else df
