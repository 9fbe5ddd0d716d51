"""Streams over several micro-batches, with restarts and repeated batches."""

import pytest
from compare import spark_rows
from conftest import SF_DIR
from pyspark.sql import functions as F

from millrace.operators import keymodels, ordered
from millrace.plans import QUERIES
from millrace.plans.keymodels import FEED_ORDER, feed_order
from millrace.session import workdir
from millrace.streaming import feeds
from millrace.streaming import operators as st


def in_slices(df, path, n):
    for i in range(n):
        df.filter(F.pmod(F.hash(*df.columns), F.lit(n)) == i).coalesce(1).write.mode("append").parquet(path)


def test_upsert_over_batches_and_restart(spark, inputs):
    work, feed = workdir(spark, "t-upsert"), inputs["change_feed"]
    in_slices(feed, f"{work}/in", 3)
    args = (["part_key"], feed_order(), list(FEED_ORDER), ["new_price"])
    st.upsert_stream(feeds.read_stream(spark, f"{work}/in", 1), work, *args)
    feed.limit(0).write.mode("append").parquet(f"{work}/in")
    after = st.upsert_stream(feeds.read_stream(spark, f"{work}/in", 1), work, *args)
    want = keymodels.apply_change_feed(feed, ["part_key"], feed_order(), ["new_price"])
    assert spark_rows(after) == spark_rows(want)


def test_repeated_batch_replaces_itself(spark):
    table = workdir(spark, "t-repeat")
    for _ in range(2):
        feeds.write_batch(spark.range(3), table, 0)
    feeds.write_batch(spark.range(3), table, 1)
    assert spark.read.parquet(table).count() == 6


def test_batches_are_folded_into_generations(spark, inputs):
    work, feed = workdir(spark, "t-folded"), inputs["change_feed"]
    in_slices(feed, f"{work}/in", 5)
    after = st.upsert_stream(feeds.read_stream(spark, f"{work}/in", 1), work, ["part_key"], feed_order(), list(FEED_ORDER), ["new_price"], every=2)
    assert spark_rows(after) == spark_rows(keymodels.apply_change_feed(feed, ["part_key"], feed_order(), ["new_price"]))
    assert {r[0] for r in spark.read.parquet(f"{work}/changes/generation=2").select("batch_id").distinct().collect()} == {-1, 4}


def test_windows_and_late_rows_are_all_rows(spark, inputs):
    work, events = workdir(spark, "t-balance"), inputs["events"].select("event_id", "ts", "event_type")
    in_slices(events, f"{work}/in", 4)
    in_slices(events.limit(3).withColumn("ts", F.lit(None).cast("timestamp_ntz")), f"{work}/in", 1)
    stream = feeds.read_stream(spark, f"{work}/in", 1)
    windows, late = st.windows_and_late(stream, work, "ts", "1 hour", lambda s: st.windowed_counts(s, "ts", "1 hour", "1 hour", None, ["event_type"]))
    assert 0 < late.count() < events.count()
    assert windows.agg(F.sum("n_rows")).first()[0] + late.count() == events.count() + 3


def test_tumbling_over_ordered_batches(spark, inputs):
    work, events = workdir(spark, "t-tumbling"), inputs["events"].select("event_id", "ts", "event_type")
    for low, high in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-21"), ("2024-01-21", "2024-02-01")):
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = feeds.read_stream(spark, f"{work}/in", 1)
    closed = st.run_closed(spark, stream, work, "ts", lambda s: st.windowed_counts(s, "ts", "1 hour", "1 hour", None, ["event_type"]))
    batch = events.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n_rows"))
    assert spark_rows(closed.select("window_start", "event_type", "n_rows")) == spark_rows(batch)


def test_late_rows_against_all_earlier_batches(spark):
    work = workdir(spark, "t-late")
    for rows in ([(1, "2024-01-10 00:00:00")], [(2, "2024-01-05 00:00:00"), (3, "2024-01-09 12:00:00")], [(4, "2024-01-08 00:00:00"), (5, "2024-01-09 00:00:00")]):
        df = spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{work}/in")
        st.split_late(feeds.read_stream(spark, f"{work}/in"), work, "ts", "1 DAY")
    assert {r.id: r.late for r in spark.read.parquet(f"{work}/rows").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_job_monitor_over_several_reports(spark):
    work = workdir(spark, "t-jobs")
    reports = [
        (1, "RUNNING", 10, "2024-01-01 00:00:00"), (1, "FINISHED", 100, "2024-01-01 00:01:30"),
        (2, "PENDING", 0, "2024-01-01 00:00:00"), (2, "RUNNING", 200, "2024-01-01 00:03:20"),
        (3, "RUNNING", 400, "2024-01-01 00:00:00"), (4, "CANCELLED", 1, "2024-01-01 00:00:00"),
        (5, "RUNNING", 0, "2024-01-01 00:00:00"), (5, "RUNNING", 400, "2024-01-01 00:06:40"), (5, "RUNNING", 800, "2024-01-01 00:13:20"),
        (6, "RUNNING", 0, "2024-01-01 00:00:00"), (6, "FINISHED", 400, "2024-01-01 00:06:40"), (7, "FINISHED", 1, None),
    ]
    df = spark.createDataFrame(reports, "job_id long, state string, elapsed_s long, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{work}/in")
    st.monitor_jobs(feeds.read_stream(spark, f"{work}/in"), work, "ts", "1 hour", 0)
    closed = st.job_outcomes(spark, work, until=st.FAR)
    assert {(r.job_id, r.outcome, str(r.decided_at)) for r in closed.collect()} == {
        (1, "finished", "2024-01-01 00:01:30"), (2, "timed_out", "2024-01-01 00:05:00"),
        (3, "timed_out", "2024-01-01 00:00:00"), (4, "cancelled", "2024-01-01 00:00:00"),
        (5, "timed_out", "2024-01-01 00:05:00"), (6, "timed_out", "2024-01-01 00:05:00"),
    }
    assert closed.count() == 6


def test_job_monitor_over_batches(spark):
    work = workdir(spark, "t-jobs")
    batches = [
        [(1, "RUNNING", 0, "2024-01-01 00:00:00"), (2, "RUNNING", 0, "2024-01-01 00:00:00")],
        [(1, "FINISHED", 200, "2024-01-01 00:03:20"), (3, "RUNNING", 0, "2024-01-01 02:00:00")],
        [(2, "FINISHED", 8000, "2024-01-01 02:13:20"), (3, "CANCELLED", 100, "2024-01-01 02:01:40"), (1, "RUNNING", 9000, "2024-01-01 02:30:00")],
    ]
    for rows in batches:
        df = spark.createDataFrame(rows, "job_id long, state string, elapsed_s long, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{work}/in")
    st.monitor_jobs(feeds.read_stream(spark, f"{work}/in", 1), work, "ts", "1 hour", 0)
    assert {r.job_id for r in st.job_outcomes(spark, work).collect()} == {1, 2, 3}
    closed = st.job_outcomes(spark, work, until=st.FAR)
    assert sorted((r.job_id, r.outcome) for r in closed.collect()) == [(1, "finished"), (2, "timed_out"), (3, "cancelled")]


JOB_BATCHES = [
    [(1, "RUNNING", 0, "2024-01-01 00:00:00"), (2, "RUNNING", 0, "2024-01-01 00:00:00"), (4, "RUNNING", 0, "2024-01-01 00:00:00")],
    [(1, "FINISHED", 200, "2024-01-01 00:03:20"), (3, "RUNNING", 0, "2024-01-01 02:00:00")],
    [(3, "RUNNING", 60, "2024-01-01 02:01:00")],
    [(2, "FINISHED", 8000, "2024-01-01 02:13:20"), (3, "CANCELLED", 100, "2024-01-01 02:01:40"), (1, "RUNNING", 9000, "2024-01-01 02:30:00")],
    [(5, "PENDING", 0, "2024-01-03 00:00:00")],
    [(1, "FINISHED", 400, "2024-01-01 00:06:40"), (6, "RUNNING", 0, "2024-01-03 00:00:01")],
]


def job_rows(spark, rows):
    df = spark.createDataFrame(rows, "job_id long, state string, elapsed_s long, ts string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def outcomes_of(spark, work, until=None):
    return sorted((r.job_id, r.outcome, str(r.decided_at)) for r in st.job_outcomes(spark, work, until).collect())


def test_job_monitor_restarts_between_all_batches(spark):
    """One run over six batches says what six runs of one batch say, and a job is decided once."""
    whole, apart = workdir(spark, "t-jobs"), workdir(spark, "t-jobs")
    for rows in JOB_BATCHES:
        for work in (whole, apart):
            job_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{work}/in")
        st.monitor_jobs(feeds.read_stream(spark, f"{apart}/in", 1), apart, "ts", "1 hour", 0)
    st.monitor_jobs(feeds.read_stream(spark, f"{whole}/in", 1), whole, "ts", "1 hour", 0)
    assert outcomes_of(spark, apart) == outcomes_of(spark, whole) == [
        (1, "finished", "2024-01-01 00:03:20"), (2, "timed_out", "2024-01-01 00:05:00"),
        (3, "cancelled", "2024-01-01 02:01:40"), (4, "timed_out", "2024-01-01 00:05:00"),
    ]
    assert [r[0] for r in outcomes_of(spark, whole, st.FAR)] == [1, 2, 3, 4, 5, 6]


def test_job_monitor_repeats_a_batch_that_failed(spark, monkeypatch):
    """The table of jobs is written, then the batch dies: the next run repeats it."""
    work = workdir(spark, "t-jobs")
    for rows in JOB_BATCHES[:2]:
        job_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{work}/in")
    with monkeypatch.context() as broken:
        broken.setattr(st, "write_batch", lambda *a: (_ for _ in ()).throw(OSError("lost")) if a[2] == 1 else feeds.write_batch(*a))
        with pytest.raises(Exception, match="lost"):
            st.monitor_jobs(feeds.read_stream(spark, f"{work}/in", 1), work, "ts", "1 hour", 0)
    assert outcomes_of(spark, work) == []
    st.monitor_jobs(feeds.read_stream(spark, f"{work}/in", 1), work, "ts", "1 hour", 0)
    assert outcomes_of(spark, work) == [(1, "finished", "2024-01-01 00:03:20")]


def test_job_monitor_forgets_decided_jobs_by_age(spark):
    work = workdir(spark, "t-jobs")
    for rows in JOB_BATCHES:
        job_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{work}/in")
    st.monitor_jobs(feeds.read_stream(spark, f"{work}/in", 1), work, "ts", "1 hour", 0, remember_s=3600)
    kept = {r.job_id for r in spark.read.parquet(f"{work}/jobs/turn=1").collect()}
    assert kept == {1, 5, 6}  # job 1 was reported again after it had been forgotten


def test_monitor_keeps_python_out_of_its_plans(spark, monkeypatch):
    plans, work = [], workdir(spark, "t-jobs")
    step = st._job_step
    monkeypatch.setattr(st, "_job_step", lambda *a: plans.append(df := step(*a)) or df)
    job_rows(spark, JOB_BATCHES[0]).write.parquet(f"{work}/in")
    st.monitor_jobs(feeds.read_stream(spark, f"{work}/in"), work, "ts", "1 hour", 0)
    assert plans and not any("Python" in (text := p._jdf.queryExecution().executedPlan().toString()) or "InPandas" in text for p in plans)


def test_parts_in_time_order_hold_all_rows(spark, inputs):
    events = inputs["events"].select("event_id", "ts")
    blank = events.limit(5).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    parts = feeds.in_time_order(events.unionByName(blank), "ts", 3)
    ends = [p.agg(F.min("ts"), F.max("ts"), F.count("*")).first() for p in parts]
    assert sum(e[2] for e in ends) == events.count() + 5 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert [p.count() for p in feeds.in_time_order(events.limit(0), "ts", 3)] == [0]


def test_session_settings_come_back(spark, inputs):
    names = [*feeds.SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled"]
    before = [spark.conf.get(n, None) for n in names]
    QUERIES["stream_tumbling"](spark, SF_DIR)
    assert [spark.conf.get(n, None) for n in names] == before


def test_late_rows_after_batches_without_times(spark):
    work = workdir(spark, "t-late")
    for rows in ([(1, None)], [(2, "2024-01-05 00:00:00")], [(3, "2024-01-01 00:00:00"), (4, None)]):
        df = spark.createDataFrame(rows, "id int, at string").select("id", F.col("at").cast("timestamp_ntz").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{work}/in")
        st.split_late(feeds.read_stream(spark, f"{work}/in"), work, "ts", "1 DAY")
    assert {r.id: r.late for r in spark.read.parquet(f"{work}/rows").collect()} == {1: False, 2: False, 3: True, 4: False}


def test_dedup_of_a_hot_key_over_batches(spark):
    work = workdir(spark, "t-dedup")
    ids = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100)
    rows = spark.range(900).select(ids.alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), (F.col("id") % 2).alias("part"))
    for part in (0, 1):
        rows.filter(F.col("part") == part).repartition(4).write.mode("append").parquet(f"{work}/in")
    stream = feeds.read_stream(spark, f"{work}/in", 3)
    feeds.drain(st.unique_rows(stream, "event_id", "ts", "1 hour"), f"{work}/out", f"{work}/checkpoint")
    got = sorted(r.event_id for r in spark.read.parquet(f"{work}/out").collect())
    assert got == sorted({r.event_id for r in rows.collect()})


def test_sessions_over_batches(spark, inputs):
    work, events = workdir(spark, "t-sessions"), inputs["events"].select("event_id", "ts", "user_id")
    for low, high in (("2024-01-01", "2024-01-15"), ("2024-01-15", "2024-02-01")):
        events.filter((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = feeds.read_stream(spark, f"{work}/in", 1)
    closed = st.run_closed(spark, stream, work, "ts", lambda s: st.session_counts(s, "ts", "1 hour", "6 hours", ["user_id"]))
    batch = ordered.sessions(events, ["user_id"], "ts", 6 * 3600, {})
    columns = ["user_id", "session_start", "session_end", "n_rows"]
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("session") else c for c in columns]
    assert spark_rows(closed.select(*ntz)) == spark_rows(batch.select(*columns))


def test_monitor_agrees_with_the_batch_outcomes(spark, inputs):
    """Once all limits have passed, a running job has timed out, and so has one that ended too late."""
    late = inputs["alter_jobs"].filter("elapsed_s > 300").select("job_id")
    batch = QUERIES["job_timeouts"](spark, SF_DIR).select("job_id", F.replace("outcome", F.lit("running"), F.lit("timed_out")).alias("outcome"))
    stream = QUERIES["stream_job_monitor"](spark, SF_DIR).select("job_id", "outcome")
    assert stream.count() == batch.count()
    assert spark_rows(stream.join(late, "job_id", "left_anti")) == spark_rows(batch.join(late, "job_id", "left_anti"))
    assert {r.outcome for r in stream.join(late, "job_id").collect()} == {"timed_out"}
