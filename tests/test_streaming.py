"""Streams over several files against the batch plans."""

import os

import pytest
from pyspark.sql import functions as F

from loomtext.operators import telemetry as M
from loomtext.plans.fixtures import Fixtures
from loomtext.session import work_path
from loomtext.streaming import jobs as J
from loomtext.streaming.requests import accepted_stream, active_keys, request_events
from loomtext.streaming.runs import event_time, read_batches, read_files, run_to_end

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark):
    """The events in four files in order of id, and the views over them as a stream."""
    events = Fixtures(spark, SF).events
    path = work_path(spark, "events")
    for i in range(4):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        events.where(f"event_id div 250 = {i}").coalesce(1).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - before:  # files are taken in order of their time
            os.utime(os.path.join(path, f), (1e9 + i * 10, 1e9 + i * 10))

    def view(name):
        fx = Fixtures(spark, SF)
        fx._made["events"] = read_files(spark, path, "*.parquet", events.schema, 1)
        return getattr(fx, name)

    return view


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_progress_over_batches(spark, split_events):
    batch = M.fold_progress(Fixtures(spark, SF).V_job_events)
    assert rows(J.progress(split_events("V_job_events")).select(*batch.columns)) == rows(batch)


def test_log_over_batches(spark, split_events):
    items = M.number_items(M.parse_log(M.split_log(Fixtures(spark, SF).V_log, keep_indent=True).select("seq", "line")))
    batch = M.annotate(items).select("seq", "kind", "ok", "empty")
    assert rows(J.annotate_log(split_events("V_log")).select("seq", "kind", "ok", "empty")) == rows(batch)


def test_notify_once_over_batches(spark, split_events):
    ends = Fixtures(spark, SF).V_job_events.where("type = 'chapter_done'")
    got = J.notify_once(split_events("V_job_events").where("type = 'chapter_done'"))
    assert rows(got) == rows(ends.select("job_id").distinct())


def test_windows_over_batches(spark, split_events):
    want = event_time(Fixtures(spark, SF).V_job_events).groupBy(F.window("ts", "1 hour").alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "type", "n")
    got = J.windowed_counts(event_time(split_events("V_job_events")), "10 minutes", "1 hour")
    assert rows(got.select("start", "type", "n")) == rows(want)


def test_late_rows_are_dropped(spark):
    path = work_path(spark, "late")
    at = lambda i, t: spark.createDataFrame([(i, t)], "seq long, t string").select("seq", F.to_timestamp("t").alias("ts"), F.lit("x").alias("type")).coalesce(1)
    for i, t in enumerate(["2024-01-01 00:05:00", "2024-01-01 05:00:00", "2024-01-01 05:30:00", "2024-01-01 00:10:00"]):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        at(i, t).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - before:
            os.utime(os.path.join(path, f), (1e9 + i * 10, 1e9 + i * 10))
    stream = read_files(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    got = {str(r.start): r.n for r in J.windowed_counts(stream, "10 minutes", "1 hour").collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 05:00:00": 2}


def test_first_requests(spark, split_events):
    jobs = event_time(split_events("V_jobs"), "created").select("id", "key", "created")
    out = work_path(spark, "requests")
    first = J.first_requests(jobs, "365 days")
    run_to_end(first, out)
    got = read_batches(spark, out, first.schema).select("key")
    assert rows(got) == rows(Fixtures(spark, SF).V_jobs.select("key").distinct())


def put_file(df, path, i):
    """One more file, newer than those there."""
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    df.coalesce(1).write.mode("append").parquet(path)
    for f in set(os.listdir(path)) - before:
        os.utime(os.path.join(path, f), (1e9 + i * 10, 1e9 + i * 10))


def test_requests_while_a_job_is_active(spark):
    """Several files and two calls give the rows of the batch twin, and state stays only for keys with an active job."""
    jobs = Fixtures(spark, SF).V_work
    events = request_events(jobs)
    path, folders = work_path(spark, "requests"), {"out": work_path(spark, "out"), "checkpoint": work_path(spark, "cp")}
    bounds = [r.at for r in events.selectExpr("ntile(6) over (order by at) as q", "at").groupBy("q").agg(F.max("at").alias("at")).orderBy("at").collect()]
    low, accepted = None, None
    for i, high in enumerate(bounds):
        part = events.where(F.col("at") <= F.lit(high))
        put_file(part.where(F.col("at") > F.lit(low)) if low else part, path, i)
        low = high
        if i in (2, 5):
            accepted = accepted_stream(read_files(spark, path, "*.parquet", events.schema, 1), **folders)
            if i == 2:
                some = accepted.count()
                # what is active now: accepted, and no end came yet
                over = events.where((F.col("at") <= F.lit(high)) & (F.col("kind") == 0)).select("id")
                assert rows(active_keys(spark, folders["checkpoint"]).selectExpr("key", "cast(id as bigint) as id")) == rows(accepted.select("key", "id").join(over, "id", "left_anti").select("key", "id"))
    want = M.accepted_requests(jobs)
    assert rows(accepted.select("key", "id")) == rows(want.select("key", "id"))
    assert 0 < some < accepted.count()


def test_jobs_that_never_end(spark):
    """With a hold a job without an end lets its key go, by the time of a later request or by a timer that frees its state."""
    jobs = Fixtures(spark, SF).V_work.withColumn("finished", F.when(F.col("id") % 3 != 0, F.col("finished")))
    events, hold = request_events(jobs), 4 * 3600
    path, folders = work_path(spark, "requests"), {"out": work_path(spark, "out"), "checkpoint": work_path(spark, "cp")}
    half = events.selectExpr("percentile_approx(unix_micros(at), 0.5) as m").first().m
    for i, part in enumerate((events.where(F.unix_micros("at") <= half), events.where(F.unix_micros("at") > half))):
        put_file(part, path, i)
        got = accepted_stream(read_files(spark, path, "*.parquet", events.schema, 1), hold, "10 minutes", **folders)
    ended = F.least("finished", F.col("created") + F.expr("interval 4 hours"))
    assert rows(got.select("key", "id")) == rows(M.accepted_requests(jobs.withColumn("finished", ended)).select("key", "id"))
    newest = events.agg(F.max("at")).first()[0]
    held = active_keys(spark, folders["checkpoint"])
    assert held.where(F.col("since") + F.expr("interval 4 hours 11 minutes") < F.lit(newest)).isEmpty()


def test_requests_of_one_moment(spark):
    """Ends come before requests of their moment; a job that ends as it starts holds nothing; ends of dropped requests do not count."""
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    jobs = spark.createDataFrame(
        [("a", 1, at(0), at(5)), ("a", 2, at(1), at(2)), ("a", 3, at(5), at(5)), ("a", 4, at(5), None), ("a", 5, at(9), at(9)), (None, 6, at(0), at(1)), (None, 7, at(0), at(1))],
        "key string, id bigint, created string, finished string",
    )
    path = work_path(spark, "requests")
    put_file(request_events(jobs), path, 0)
    got = accepted_stream(read_files(spark, path, "*.parquet", request_events(jobs).schema))
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 6]
    typed = jobs.select("key", "id", *[F.to_timestamp(c).alias(c) for c in ("created", "finished")])
    assert sorted(r.id for r in M.accepted_requests(typed.where("key is not null")).collect()) == [1, 3, 4]


def test_open_sessions_go_on(spark, split_events):
    """What two calls report, closed and open, are the sessions of all events so far."""
    folders = {"out": work_path(spark, "out"), "checkpoint": work_path(spark, "cp")}
    events, path = Fixtures(spark, SF).events, work_path(spark, "events")
    for i, high in enumerate((400, 1001)):
        put_file(events.where(f"event_id >= {(0, 400)[i]} and event_id < {high}"), path, i)
        fx = Fixtures(spark, SF)
        fx._made["events"] = read_files(spark, path, "*.parquet", events.schema, 1)
        got = J.all_sessions(event_time(fx.V_job_events), "10 minutes", "2 hours", **folders)
        so_far = Fixtures(spark, SF)
        so_far._made["events"] = events.where(f"event_id < {high}")
        want = event_time(so_far.V_job_events).groupBy(F.session_window("ts", "2 hours").alias("s"), "job_id").agg(F.count(F.lit(1)).alias("n"))
        assert rows(got.select("job_id", "start", "n")) == rows(want.select("job_id", "s.start", "n"))
        assert got.where("open").count() > 0


def test_ingest_reads_only_new_files(spark):
    docs = Fixtures(spark, SF).documents
    path, out, checkpoint = (work_path(spark, n) for n in ("in", "out", "cp"))
    total = []
    for low, high in ((0, 100), (100, 200)):
        docs.where(f"doc_id >= {low} and doc_id < {high}").write.mode("append").parquet(path)
        stream = read_files(spark, path, "*.parquet", docs.schema)
        chunks = J.ingest_texts(stream, checkpoint=checkpoint, out=out)
        total.append(chunks.select("doc_id").distinct().count())
        assert chunks.count() == chunks.select("doc_id", "chunk_idx").distinct().count()
    n = docs.where("length(trim(text)) > 0").count()
    assert total == [docs.where("doc_id < 100 and length(trim(text)) > 0").count(), n]


def test_a_table_may_be_a_folder_of_files(spark):
    path = work_path(spark, "in")
    docs = spark.createDataFrame([(1, "a", "One. Two."), (2, "b", "Three."), (3, "b", None)], "doc_id bigint, source string, text string")
    docs.repartition(2).write.parquet(f"{path}/documents.parquet")
    docs.coalesce(1).write.parquet(f"{path}/others.parquet")
    got = J.ingest_texts(read_files(spark, path, "documents.parquet", docs.schema))
    assert rows(got.select("doc_id", "chunk_idx", "chunk")) == ["(1, 0, 'One.\\n\\nTwo.')", "(2, 0, 'Three.')"]
    # no files yet: no batch, no rows
    assert J.ingest_texts(read_files(spark, path, "missing.parquet", docs.schema)).collect() == []


def test_streams_go_on(spark):
    """Two calls with the same folders equal one over all files, and the second reads new files only."""
    events, path = Fixtures(spark, SF).events, work_path(spark, "events")
    runs = {
        "progress": (lambda v, **kw: J.progress(v("V_job_events"), **kw), lambda fx: M.fold_progress(fx.V_job_events)),
        "log": (
            lambda v, **kw: J.annotate_log(v("V_log"), **kw).select("seq", "kind", "ok", "empty"),
            lambda fx: M.annotate(M.number_items(M.parse_log(M.split_log(fx.V_log, keep_indent=True).select("seq", "line")))).select("seq", "kind", "ok", "empty"),
        ),
        "once": (
            lambda v, **kw: J.notify_once(event_time(v("V_job_events").where("type = 'chapter_done'")), "10 minutes", **kw),
            lambda fx: fx.V_job_events.where("type = 'chapter_done'").select("job_id").distinct(),
        ),
    }
    folders = {name: {"out": work_path(spark, "out"), "checkpoint": work_path(spark, "cp")} for name in runs}
    for low, high in ((0, 500), (500, 1001)):
        before = set(os.listdir(path)) if os.path.isdir(path) else set()
        events.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - before:
            os.utime(os.path.join(path, f), (1e9 + low, 1e9 + low))

        def view(name):
            fx = Fixtures(spark, SF)
            fx._made["events"] = read_files(spark, path, "*.parquet", events.schema, 1)
            return getattr(fx, name)

        so_far = Fixtures(spark, SF)
        so_far._made["events"] = events.where(f"event_id < {high}")
        for name, (stream, batch) in runs.items():
            want = batch(so_far)
            assert rows(stream(view, **folders[name]).select(*want.columns)) == rows(want), name
