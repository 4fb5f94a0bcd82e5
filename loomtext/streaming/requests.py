"""Requests as they come in: which of them start a job, with state only for keys whose job is queued or running."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import work_path
from .runs import read_batches, run_to_end

#: the store that custom state needs
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
REQUEST, END = 1, 0


def request_events(jobs: DataFrame, created: str = "created", finished: str = "finished") -> DataFrame:
    """(key, id, at, kind) from rows that know both ends of a job; a job without an end has no end event."""
    event = lambda c, kind: F.struct(F.col(c).cast("timestamp").alias("at"), F.lit(kind).alias("kind"))
    both = jobs.select("key", "id", F.explode(F.array(event(created, REQUEST), event(finished, END))).alias("e"))
    return both.select("key", "id", "e.*").where(F.col("at").isNotNull())


class ActiveJob(StatefulProcessor):
    """The job that holds a key. Its end frees the state; without one a timer does, ``hold`` microseconds after its request."""

    def __init__(self, hold: int | None):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "id string, since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "kind", "id"], kind="stable")
        held = self.active.get() if self.active.exists() else None
        before, accepted = held, []
        moment, over = None, set()
        for at, kind, name, place in zip(batch["at_us"], batch["kind"], batch["id"].astype(str), batch.index):
            if at != moment:
                moment, over = at, set()
            if held is not None and self.hold is not None and at >= held[1] + self.hold:
                held = None
            if kind == END:
                over.add(name)
                if held is not None and held[0] == name:
                    held = None
            elif held is None:
                accepted.append(place)
                # a job that ends at the moment of its request holds nothing
                held = None if name in over else (name, int(at))
        if held != before:
            self._keep(held)
        yield batch.loc[accepted, ["key", "id", "at"]]

    def _keep(self, held: tuple[str, int] | None) -> None:
        if self.hold is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held is None:
            self.active.clear()
            return
        self.active.update(held)
        if self.hold is not None:
            self.handle.registerTimer(-(-(held[1] + self.hold) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        self.active.clear()
        return iter([])

    def close(self) -> None:
        pass


def accepted_stream(
    events: DataFrame, hold_seconds: int | None = None, delay: str = "1 hour", out: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Accepted requests (key, id, at) of a stream of events (key, id, at, kind): the stream form of ``accepted_requests``.

    A request is dropped while an accepted job of its key is active, from its request until its end event; ends of dropped
    requests count for nothing. Inside a micro-batch events go by time, ends before requests of the same moment; micro-batches
    have to come in order of time, which is the order in which events happen. A key has state only while its job is active.
    With ``hold_seconds`` a job whose end never comes counts as ended that long after its request, and a timer frees its state once
    the watermark, ``delay`` behind the newest event, has passed that time; without it such a job holds its key for ever.
    Null keys count as one key.
    """
    spark, out = events.sparkSession, out or work_path(events.sparkSession, "accepted")
    hold = None if hold_seconds is None else hold_seconds * 1_000_000
    schema = T.StructType([T.StructField("key", events.schema["key"].dataType), T.StructField("id", events.schema["id"].dataType), T.StructField("at", T.TimestampType())])
    timed = events.select("key", "id", "at", "kind")
    if hold is not None:
        timed = timed.withWatermark("at", delay)
    accepted = (
        timed.withColumn("at_us", F.unix_micros("at"))
        .groupBy("key")
        .transformWithStateInPandas(ActiveJob(hold), schema, "append", "None" if hold is None else "EventTime")
    )
    run_to_end(accepted, out, checkpoint=checkpoint, settings=STORE)
    return read_batches(spark, out, schema).drop("batch")


def active_keys(spark, checkpoint: str) -> DataFrame:
    """(key, id, since) of the jobs that the state of an ``accepted_stream`` holds."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "active").load()
    since: Column = F.timestamp_micros("value.since")
    return state.select(F.col("key.key").alias("key"), F.col("value.id").alias("id"), since.alias("since"))
