"""Streaming queries: each drains a given table as a stream and returns what it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settings, workdir
from ..sources import versions
from ..streaming import operators as st
from .keymodels import EVENT_DAYS, FEED_ORDER, LAST_CHANGE, VIEWS, event_measures, feed_order
from .registry import query


def plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


ARRIVALS = 3


def replayed_events(t, name, build):
    """The events arrive in time order, in parts; the windows that ``build`` makes of them."""
    parts = st.in_time_order(t["events"], "ts", ARRIVALS)
    return st.replay(t.spark, parts, workdir(t.spark, name), "ts", build)


@query("stream_dedup", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_dedup(t):
    """Every event is sent twice: two streams read the inbox."""
    work = workdir(t.spark, "stream-dedup")
    for part in st.in_time_order(t["events"], "ts", ARRIVALS):
        part.write.mode("append").parquet(f"{work}/in")
        sent = st.read_stream(t.spark, f"{work}/in").unionByName(st.read_stream(t.spark, f"{work}/in"))
        with settings(t.spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):  # no window to close
            st.drain(st.unique_rows(sent, "event_id", "ts", "1 hour"), f"{work}/out", f"{work}/checkpoint")
    return plain_times(t.spark.read.parquet(f"{work}/out"), "ts")


@query("stream_upsert", f"SELECT part_key, new_price FROM ({LAST_CHANGE}) AS l WHERE op = 'U'")
def stream_upsert(t):
    """The feed arrives in parts; what they come to is committed as the table's next version."""
    work, feed = workdir(t.spark, "stream-upsert"), t["change_feed"]
    for part in range(ARRIVALS):
        feed.filter(F.pmod("seq1", F.lit(ARRIVALS)) == part).write.mode("append").parquet(f"{work}/in")
        rows = st.upsert_stream(st.read_stream(t.spark, f"{work}/in"), work, ["part_key"], feed_order(), list(FEED_ORDER), ["new_price"])
    versions.commit(rows, f"{work}/table", "feed")
    return versions.read(t.spark, f"{work}/table")


@query("stream_tumbling", """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_rows FROM events GROUP BY 1, 2, 3
""")
def stream_tumbling(t):
    closed = replayed_events(t, "stream-tumbling", lambda s: st.windowed_counts(s, "ts", "1 hour", "1 hour", None, ["event_type"]))
    return plain_times(closed, "window_start", "window_end")


@query("stream_window_balance", "SELECT count(*) AS n_rows, CAST(count(*) AS BIGINT) AS n_counted FROM events")
def stream_window_balance(t):
    """Files out of time order, one a batch: rows in windows and rows too late are all rows."""
    work = workdir(t.spark, "stream-balance")
    t["events"].repartition(ARRIVALS, "event_id").write.parquet(f"{work}/in")
    stream = st.read_stream(t.spark, f"{work}/in", files_per_batch=1)
    windows, late = st.windows_and_late(stream, work, "ts", "1 hour", lambda s: st.windowed_counts(s, "ts", "1 hour", "1 hour", None, ["event_type"]))
    parts = [t["events"].select(F.lit(1), F.lit(0)), windows.select(F.lit(0), "n_rows"), late.select(F.lit(0), F.lit(1))]
    counts = reduce(DataFrame.union, parts).toDF("given", "counted")
    return counts.agg(F.sum("given").alias("n_rows"), F.sum("counted").alias("n_counted"))


@query("stream_sliding", """
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_rows
FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) FOR k IN range(4)]) AS w FROM events) AS e GROUP BY 1, 2, 3
""")
def stream_sliding(t):
    closed = replayed_events(t, "stream-sliding", lambda s: st.windowed_counts(s, "ts", "1 hour", "1 hour", "15 minutes", ["event_type"]))
    return plain_times(closed, "window_start", "window_end")


@query("stream_sessions", """
WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events),
numbered AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_rows FROM numbered GROUP BY user_id, s
""")
def stream_sessions(t):
    closed = replayed_events(t, "stream-sessions", lambda s: st.session_counts(s, "ts", "1 hour", "6 hours", ["user_id"]))
    return plain_times(closed, "session_start", "session_end")


@query("stream_late_rows", """
SELECT event_id, event_type, coalesce(event_type = 'error', FALSE)
  AND ts < (SELECT max(ts) FROM events WHERE event_type IS DISTINCT FROM 'error') - INTERVAL 1 DAY AS late FROM events
""")
def stream_late_rows(t):
    """Errors arrive after everything else; those a day behind by then are late."""
    work, events = workdir(t.spark, "stream-late"), t["events"]
    for arrival in (events.filter("event_type IS DISTINCT FROM 'error'"), events.filter("event_type = 'error'")):
        arrival.write.mode("append").parquet(f"{work}/inbox")
        st.split_late(st.read_stream(t.spark, f"{work}/inbox"), work, "ts", "1 DAY")
    return t.spark.read.parquet(f"{work}/rows").select("event_id", "event_type", "late")


@query("stream_job_monitor", """
SELECT job_id, CASE WHEN state = 'FINISHED' AND ended <= deadline THEN 'finished' WHEN state = 'CANCELLED' AND ended <= deadline THEN 'cancelled' ELSE 'timed_out' END AS outcome,
  CASE WHEN state IN ('FINISHED', 'CANCELLED') AND ended <= deadline THEN ended ELSE deadline END AS decided_at
FROM (SELECT job_id, state, ts + to_seconds(elapsed_s) AS ended, ts + to_seconds(300) AS deadline FROM alter_jobs) AS j
""")
def stream_job_monitor(t):
    """Each job reports when it starts, while it runs, and how it stands after its elapsed time; the reports arrive in parts."""
    after = F.array(
        F.struct(F.lit(0).alias("s"), F.lit("PENDING").alias("state")),
        F.struct(F.floor(F.col("elapsed_s") / 2).cast("int").alias("s"), F.lit("RUNNING").alias("state")),
        F.struct(F.col("elapsed_s").cast("int").alias("s"), F.col("state")),
    )
    reports = t["alter_jobs"].select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(after).alias("r")).select(
        "job_id", F.timestamp_micros(F.unix_micros("ts") + F.col("r.s").cast("long") * 1_000_000).alias("ts"), F.col("r.s").alias("elapsed_s"), "r.state"
    )
    work = workdir(t.spark, "stream-jobs")
    for part in st.in_time_order(reports, "ts", ARRIVALS):
        part.write.mode("append").parquet(f"{work}/in")
        st.monitor_jobs(st.read_stream(t.spark, f"{work}/in"), work, "ts", "1 hour", 0)
    return plain_times(st.job_outcomes(t.spark, work, until=st.FAR), "decided_at")


@query("stream_aggregate_key", EVENT_DAYS)
def stream_aggregate_key(t):
    work = workdir(t.spark, "stream-aggregate")
    for part in st.in_time_order(t["events"], "ts", ARRIVALS):
        part.write.mode("append").parquet(f"{work}/in")
        merged = st.aggregate_stream(event_measures(st.read_stream(t.spark, f"{work}/in")), work, ["day", "event_type"], VIEWS)
    return merged
