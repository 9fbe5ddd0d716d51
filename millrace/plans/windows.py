"""Window queries over the query log and the job log."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordered, workload
from .joins import grouped_log
from .registry import query


@query("concurrency_profile", """
WITH points AS (SELECT rg_name, ts_start AS tick, 1 AS d FROM grouped_audit
  UNION ALL SELECT rg_name, ts_start + to_milliseconds(query_time_ms), -1 FROM grouped_audit),
running AS (SELECT rg_name, tick, d, sum(d) OVER (PARTITION BY rg_name ORDER BY tick, d ROWS UNBOUNDED PRECEDING) AS n FROM points),
peaks AS (SELECT rg_name, CAST(tick AS DATE) AS day, CAST(max(greatest(n, n - d)) AS BIGINT) AS peak FROM running GROUP BY 1, 2)
SELECT p.rg_name, p.day, p.peak, nullif(g.concurrency_limit, 0) AS concurrency_limit, coalesce(p.peak > nullif(g.concurrency_limit, 0), FALSE) AS over_limit
FROM peaks p LEFT JOIN resource_groups g ON g.rg_name = p.rg_name
""")
def concurrency_profile(t):
    return workload.concurrency_peaks(grouped_log(t), t["resource_groups"])


@query("session_summary", """
WITH gaps AS (SELECT *, CASE WHEN ts_start - lag(ts_start) OVER (PARTITION BY user_name ORDER BY ts_start) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM audit),
numbered AS (SELECT *, sum(g) OVER (PARTITION BY user_name ORDER BY ts_start ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_name, CAST(s AS BIGINT) AS session_no, min(ts_start) AS session_start, max(ts_start) AS session_end, count(*) AS n_rows,
  CAST(sum(scan_rows) AS BIGINT) AS scan_rows FROM numbered GROUP BY user_name, s
""")
def session_summary(t):
    return ordered.sessions(t["audit"], ["user_name"], "ts_start", 6 * 3600, {"scan_rows": F.col("scan_rows")})


@query("job_last_state", """
SELECT table_id, ts, job_id, state FROM alter_jobs QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY ts DESC, job_id DESC) = 1
""")
def job_last_state(t):
    return workload.job_last_state(t["alter_jobs"])


@query("job_timeouts", """
SELECT job_id, table_id, CASE state WHEN 'FINISHED' THEN 'finished' WHEN 'CANCELLED' THEN 'cancelled'
  ELSE CASE WHEN elapsed_s >= 300 THEN 'timed_out' ELSE 'running' END END AS outcome FROM alter_jobs
""")
def job_timeouts(t):
    outcome = workload.job_outcome(F.col("state"), F.col("elapsed_s"), 0)
    return t["alter_jobs"].select("job_id", "table_id", outcome.alias("outcome"))


@query("queue_moving_avg", """
SELECT query_id, db, round(avg(pending_time_ms) OVER (PARTITION BY db ORDER BY ts_start, query_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS moving_mean FROM audit
""")
def queue_moving_avg(t):
    rows = t["audit"].select("query_id", "db", "ts_start", "pending_time_ms")
    means = ordered.moving_mean(rows, ["db"], ["ts_start", "query_id"], "pending_time_ms", 10)
    return means.select("query_id", "db", F.round("moving_mean", 4).alias("moving_mean"))


@query("day_over_day", """
SELECT db, day, n, scan_bytes, scan_bytes - lag(scan_bytes) OVER (PARTITION BY db ORDER BY day) AS change FROM (
  SELECT db, CAST(ts_start AS DATE) AS day, count(*) AS n, CAST(sum(scan_bytes) AS BIGINT) AS scan_bytes FROM audit GROUP BY 1, 2) AS d
""")
def day_over_day(t):
    days = t["audit"].groupBy("db", F.to_date("ts_start").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("scan_bytes").alias("scan_bytes"))
    before = F.lag("scan_bytes").over(W.partitionBy("db").orderBy("day"))
    return days.withColumn("change", F.col("scan_bytes") - before)


@query("latency_deciles", """
SELECT query_id, db, CAST(ntile(10) OVER (PARTITION BY db ORDER BY query_time_ms, query_id) AS INTEGER) AS tile,
  round(percent_rank() OVER (PARTITION BY db ORDER BY query_time_ms), 9) AS percent_rank FROM audit
""")
def latency_deciles(t):
    rows = t["audit"].select("query_id", "db", "query_time_ms")
    ranked = ordered.deciles(rows, ["db"], "query_time_ms", ["query_id"])
    return ranked.select("query_id", "db", "tile", F.round("percent_rank", 9).alias("percent_rank"))
