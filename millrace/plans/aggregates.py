"""Aggregations over the query log, definitions and table rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ddl
from ..functions.text import digest
from ..operators import ordered, quality, search, workload
from .joins import grouped_log
from .registry import query

DIGEST = r"md5(regexp_replace(regexp_replace(regexp_replace(stmt, '''(?:[^'']|'''')*''', '?', 'g'), '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g'))"


@query("digest_stats", f"""
SELECT {DIGEST} AS digest, count(*) AS n_queries, CAST(sum(cpu_cost_ns) AS BIGINT) AS cpu_ns, max(query_time_ms) AS max_ms,
  round(avg(query_time_ms), 4) AS mean_ms FROM audit GROUP BY 1
""")
def digest_stats(t):
    return workload.digest_stats(t["audit"]).withColumn("mean_ms", F.round("mean_ms", 4))


USAGE = "count(*) AS n_queries, CAST(sum(scan_bytes) AS BIGINT) AS scan_bytes, CAST(sum(cpu_cost_ns) AS BIGINT) AS cpu_ns"


def usage():
    return [F.count(F.lit(1)).alias("n_queries"), F.sum("scan_bytes").alias("scan_bytes"), F.sum("cpu_cost_ns").alias("cpu_ns")]


@query("usage_rollup", f"""
SELECT db, user_name, CAST(grouping(db) * 2 + grouping(user_name) AS BIGINT) AS level, {USAGE} FROM audit GROUP BY ROLLUP (db, user_name)
""")
def usage_rollup(t):
    return t["audit"].rollup("db", "user_name").agg(F.grouping_id().cast("bigint").alias("level"), *usage())


@query("usage_cube", f"""
SELECT rg_name, db, state, CAST(grouping(rg_name) * 4 + grouping(db) * 2 + grouping(state) AS BIGINT) AS level, {USAGE}
FROM grouped_audit GROUP BY CUBE (rg_name, db, state)
""")
def usage_cube(t):
    return grouped_log(t).cube("rg_name", "db", "state").agg(F.grouping_id().cast("bigint").alias("level"), *usage())


@query("usage_grouping_sets", f"""
SELECT rg_name, db, state, {USAGE} FROM grouped_audit GROUP BY GROUPING SETS ((rg_name, db), (rg_name, state), ())
""")
def usage_grouping_sets(t):
    sets = [[F.col("rg_name"), F.col("db")], [F.col("rg_name"), F.col("state")], []]
    keys = [F.col("rg_name"), F.col("db"), F.col("state")]
    return grouped_log(t).groupingSets(sets, *keys).agg(*usage()).select("rg_name", "db", "state", "n_queries", "scan_bytes", "cpu_ns")


@query("error_rate", """
SELECT db, state, error_code, count(*) AS n_queries,
  count(*) / sum(count(*)) OVER (PARTITION BY db) AS share FROM audit GROUP BY 1, 2, 3
""")
def error_rate(t):
    counts = t["audit"].groupBy("db", "state", "error_code").agg(F.count(F.lit(1)).alias("n_queries"))
    return counts.withColumn("share", F.col("n_queries") / F.sum("n_queries").over(W.partitionBy("db")))


@query("latency_percentiles", """
SELECT rg_name, metric, count(*) AS n_rows, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99
FROM (SELECT rg_name, 'run' AS metric, query_time_ms AS v FROM grouped_audit UNION ALL
      SELECT rg_name, 'queue', pending_time_ms FROM grouped_audit) AS m GROUP BY 1, 2
""")
def latency_percentiles(t):
    cells = F.array(
        F.struct(F.lit("run").alias("metric"), F.col("query_time_ms").alias("v")),
        F.struct(F.lit("queue").alias("metric"), F.col("pending_time_ms").alias("v")),
    )
    long = grouped_log(t).select("rg_name", F.explode(cells).alias("c")).select("rg_name", "c.*")
    return ordered.exact_percentiles(long, ["rg_name", "metric"], "v", [0.5, 0.95, 0.99], 1000)


@query("distinct_users", "SELECT CAST(ts_start AS DATE) AS day, count(DISTINCT user_name) AS n_users FROM audit GROUP BY 1")
def distinct_users(t):
    return t["audit"].groupBy(F.to_date("ts_start").alias("day")).agg(F.count_distinct("user_name").alias("n_users"))


@query("distinct_users_sketch")
def distinct_users_sketch(t):
    """Sketches per day, merged to the approximate users so far in the month."""
    days = t["audit"].groupBy(F.to_date("ts_start").alias("day")).agg(F.hll_sketch_agg("user_name").alias("sketch"))
    months = days.groupBy(F.date_trunc("month", "day").cast("date").alias("month"))
    return months.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_users"))


@query("distinct_users_sketch_close", """
SELECT date_trunc('month', ts)::DATE AS month, TRUE AS close FROM events GROUP BY 1
""")
def distinct_users_sketch_close(t):
    """Is each month's estimate within five per cent of the exact number?"""
    exact = t["audit"].groupBy(F.date_trunc("month", "ts_start").cast("date").alias("month")).agg(F.count_distinct("user_name").alias("exact"))
    joined = distinct_users_sketch(t).join(exact, "month")
    return joined.select("month", (F.abs(F.col("n_users") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("quota_report", """
SELECT d.db, coalesce(u.used_bytes, 0) AS used_bytes, coalesce(r.n, 0) AS used_replicas,
  CASE d.db WHEN 'analytics' THEN 104857600 WHEN 'app_db' THEN 10737418240 END AS quota_bytes,
  CAST(nullif(d.replica_quota, 0) AS INTEGER) AS replica_quota,
  coalesce(u.used_bytes > CASE d.db WHEN 'analytics' THEN 104857600 WHEN 'app_db' THEN 10737418240 END, FALSE) AS over_data,
  coalesce(r.n > nullif(d.replica_quota, 0), FALSE) AS over_replicas
FROM databases d LEFT JOIN (SELECT db, CAST(sum(scan_bytes) AS BIGINT) AS used_bytes FROM audit GROUP BY 1) AS u ON u.db = d.db
LEFT JOIN (SELECT CASE p_partkey % 3 WHEN 0 THEN 'analytics' WHEN 1 THEN 'app_db' ELSE 'metrics' END AS db, CAST(sum(p_size * (1 + p_partkey % 3)) AS BIGINT) AS n
  FROM part GROUP BY 1) AS r ON r.db = d.db
""")
def quota_report(t):
    parsed = ddl.parse_tables(t["ddl_corpus"], "table_id", "ddl")
    db = F.element_at(F.array(F.lit("analytics"), F.lit("app_db"), F.lit("metrics")), (F.col("table_id") % 3 + 1).cast("int"))
    return workload.quota_report(t["audit"], parsed.select(db.alias("db"), workload.table_replicas().alias("replicas")), t["databases"])


@query("drop_guard", """
SELECT n_name AS db, count(*) OVER (PARTITION BY n_name) AS n_tables, c_name AS table_name FROM nation JOIN customer ON c_nationkey = n_nationkey
""")
def drop_guard(t):
    databases = t["nation"].select(F.col("n_name").alias("db"), "n_nationkey")
    tables = t["customer"].join(databases, F.col("c_nationkey") == F.col("n_nationkey")).select("db", F.col("c_name").alias("table_name"))
    return workload.drop_guard(databases, tables)


PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _profile_sql(column):
    return f"""SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) - count({column}) AS n_null, count(DISTINCT {column}) AS n_distinct,
  CAST(min({column}) AS VARCHAR) AS min_value, CAST(max({column}) AS VARCHAR) AS max_value, CAST(max(length(CAST({column} AS VARCHAR))) AS INTEGER) AS max_length,
  count(DISTINCT {column}) >= 100 AND count(DISTINCT {column}) >= count(*) * 0.0001 AS bitmap_fit FROM orders"""


@query("column_profile", "\nUNION ALL\n".join(map(_profile_sql, PROFILED)))
def column_profile(t):
    return quality.column_profile(t["orders"], t["orders"].columns)


@query("column_sketch", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, TRUE AS distinct_close,
  CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, CAST(max(length(CAST({c} AS VARCHAR))) AS INTEGER) AS max_length FROM orders"""
    for c in PROFILED))
def column_sketch(t):
    """The one-pass profile; are its distinct counts within four standard errors of the exact ones?"""
    exact = quality.column_profile(t["orders"], t["orders"].columns).select("column_name", F.col("n_distinct").alias("n_exact"))
    sketch = quality.column_sketch(t["orders"]).join(exact, "column_name")
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * 0.02 * F.col("n_exact")
    return sketch.select("column_name", "n_rows", "n_null", close.alias("distinct_close"), "min_value", "max_value", "max_length")


TIGHT_PARTS = [
    ("p_name", "VARCHAR(10)", False), ("p_brand", "BIGINT", True), ("p_retailprice", "DECIMAL(5, 2)", True),
    ("p_size", "TINYINT", False), ("p_type", "VARCHAR(7)", True),
]


@query("constraint_violations", """
SELECT 'p_name' AS column_name, 'NOT_NULL' AS rule, count(*) FILTER (WHERE p_name IS NULL) AS n_rows FROM part
UNION ALL SELECT 'p_name', 'LENGTH', count(*) FILTER (WHERE length(p_name) > 10) FROM part
UNION ALL SELECT 'p_brand', 'CAST', count(*) FILTER (WHERE p_brand IS NOT NULL AND TRY_CAST(p_brand AS BIGINT) IS NULL) FROM part
UNION ALL SELECT 'p_retailprice', 'RANGE', count(*) FILTER (WHERE p_retailprice IS NOT NULL AND TRY_CAST(p_retailprice AS DECIMAL(5, 2)) IS NULL) FROM part
UNION ALL SELECT 'p_size', 'NOT_NULL', count(*) FILTER (WHERE p_size IS NULL) FROM part
UNION ALL SELECT 'p_size', 'CAST', count(*) FILTER (WHERE p_size IS NOT NULL AND TRY_CAST(p_size AS TINYINT) IS NULL) FROM part
UNION ALL SELECT 'p_type', 'LENGTH', count(*) FILTER (WHERE length(p_type) > 7) FROM part
""")
def constraint_violations(t):
    return quality.constraint_violations(t["part"], TIGHT_PARTS)


@query("plan_cost_accuracy", """
SELECT db, round(corr(plan_cpu_costs, CAST(cpu_cost_ns AS DOUBLE)), 6) AS correlation,
  round(sum(cpu_cost_ns) / sum(plan_cpu_costs), 6) AS cost_ratio FROM audit GROUP BY 1
""")
def plan_cost_accuracy(t):
    planned, actual = F.col("plan_cpu_costs"), F.col("cpu_cost_ns").cast("double")
    return t["audit"].groupBy("db").agg(
        F.round(F.corr(planned, actual), 6).alias("correlation"),
        F.round(F.sum("cpu_cost_ns") / F.sum(planned), 6).alias("cost_ratio"),
    )


@query("relation_popularity", """
SELECT relation, count(*) AS n_queries, CAST(sum(scan_rows) AS BIGINT) AS scan_rows, count(DISTINCT user_name) AS n_users
FROM (SELECT user_name, scan_rows, unnest(list_distinct(string_split(queried_relations, ','))) AS relation FROM audit) AS r GROUP BY 1
""")
def relation_popularity(t):
    return workload.relation_popularity(t["audit"], F.split("queried_relations", ","))


@query("relation_pairs", """
WITH used AS (SELECT query_id, unnest(list_distinct(string_split(queried_relations, ','))) AS relation FROM audit)
SELECT a.relation AS left_table, b.relation AS right_table, count(*) AS n_queries
FROM used a JOIN used b ON a.query_id = b.query_id AND a.relation < b.relation GROUP BY 1, 2
""")
def relation_pairs(t):
    return workload.relation_pairs(t["audit"], F.split("queried_relations", ","))


@query("mv_hit_ratio", """
SELECT mv, count(*) AS n_candidate, count(*) FILTER (WHERE list_contains(string_split(hit_mvs, ','), mv)) AS n_hit,
  count(*) FILTER (WHERE list_contains(string_split(hit_mvs, ','), mv)) / count(*) AS hit_ratio
FROM (SELECT hit_mvs, unnest(string_split(candidate_mvs, ',')) AS mv FROM audit) AS c WHERE mv <> '' GROUP BY 1
""")
def mv_hit_ratio(t):
    return workload.view_hit_ratio(t["audit"])


LOOKUPS = """
SELECT op || ':' || a.value || ':' || b.value AS lookup, op, a.value AS kind, b.value AS parity
FROM (VALUES ('AND'), ('OR')) AS o(op), (VALUES ('error'), ('view'), ('click'), ('signup'), ('purchase')) AS a(value), (VALUES ('even'), ('odd')) AS b(value)
"""


@query("bitmap_index", f"""
SELECT l.lookup, l.op, count(*) FILTER (WHERE CASE WHEN l.op = 'AND' THEN e.event_type = l.kind AND e.parity = l.parity ELSE e.event_type = l.kind OR e.parity = l.parity END) AS n_rows
FROM ({LOOKUPS}) AS l, (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM events) AS e GROUP BY 1, 2
""")
def bitmap_index(t):
    """What a bitmap of each value would be counted for: the rows under AND and OR of two values."""
    lookups = {}
    for kind in ("error", "view", "click", "signup", "purchase"):
        for parity, rest in (("even", 0), ("odd", 1)):
            a, b = F.col("event_type") == kind, F.col("user_id") % 2 == rest
            lookups |= {f"AND:{kind}:{parity}": ("AND", a & b), f"OR:{kind}:{parity}": ("OR", a | b)}
    return search.count_lookups(t["events"], lookups)


@query("state_pivot", """
SELECT CAST(ts_start AS DATE) AS day, count(*) FILTER (WHERE state = 'OK') AS ok_n, count(*) FILTER (WHERE state = 'EOF') AS eof_n,
  count(*) FILTER (WHERE state = 'ERR') AS err_n FROM audit GROUP BY 1
""")
def state_pivot(t):
    states = {"OK": "ok_n", "EOF": "eof_n", "ERR": "err_n"}
    pivoted = t["audit"].groupBy(F.to_date("ts_start").alias("day")).pivot("state", list(states)).agg(F.count(F.lit(1)))
    return pivoted.select("day", *(F.coalesce(s, F.lit(0).cast("bigint")).alias(n) for s, n in states.items()))


@query("sql_digest", f"SELECT query_id, {DIGEST} AS digest FROM audit")
def sql_digest(t):
    return t["audit"].select("query_id", digest(F.col("stmt")).alias("digest"))
