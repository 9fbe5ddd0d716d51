"""Joins: schema differences, existence, workload classification, as-of and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import prefer_recorded
from ..operators import ordered, schema, workload
from .registry import query

REPLACING = ["database", "name", "engine", "key_type", "key_columns", "partition", "dist", "properties"]


def grouped_log(t):
    return workload.classify(t["audit"], t["classifiers"])


@query("column_diff", "SELECT table_id, name, kind, d_ord AS new_ord, a_ord AS old_ord, new_type FROM column_changes")
def column_diff(t):
    diff = schema.column_diff(t["desired_columns"], t["actual_columns"])
    return diff.select("table_id", "name", "kind", "new_ord", "old_ord", "new_type")


@query("replacement_plan", """
WITH specs AS (SELECT *, coalesce(nullif(old_dist, ''), nullif(server_dist, ''), '') AS recorded_dist FROM table_specs)
SELECT s.table_id, CASE
    WHEN s.old_database <> s.new_database OR s.old_name <> s.new_name OR s.old_engine <> s.new_engine OR s.old_key_type <> s.new_key_type
      OR s.old_key_columns <> s.new_key_columns OR s.old_partition <> s.new_partition OR s.recorded_dist <> s.new_dist OR s.old_properties <> s.new_properties THEN 'REPLACE'
    WHEN s.old_comment IS DISTINCT FROM s.new_comment OR coalesce(c.n, 0) > 0 THEN 'IN_PLACE' ELSE 'NO_OP' END AS plan,
  coalesce(c.n, 0) AS n_changes
FROM specs s LEFT JOIN (SELECT table_id, count(*) AS n FROM column_changes GROUP BY 1) AS c ON c.table_id = s.table_id
""")
def replacement_plan(t):
    """The recorded distribution is the one a user wrote, if any: a re-quoted server clause is no change."""
    specs = t["table_specs"].withColumn("old_dist", prefer_recorded(F.col("old_dist"), F.col("server_dist")))
    changes = schema.column_diff(t["desired_columns"], t["actual_columns"])
    return schema.replacement_plan(specs, changes, [(f"old_{a}", f"new_{a}") for a in REPLACING], [("old_comment", "new_comment")])


TABLE_NAMES = "SELECT p_partkey AS table_id, 't' || CAST(p_partkey AS STRING) AS name FROM part"


@query("name_lookup", f"""
SELECT r.req_id, r.name, max(n.table_id) AS table_id FROM requested_names r LEFT JOIN ({TABLE_NAMES}) AS n
ON lower(n.name) = lower(r.name) GROUP BY 1, 2
""")
def name_lookup(t):
    return schema.exact_names(t["requested_names"], t.sql(TABLE_NAMES), "table_id").select("req_id", "name", "table_id")


@query("existence_flags", f"""
SELECT r.req_id, r.name, EXISTS (SELECT 1 FROM ({TABLE_NAMES}) AS n WHERE lower(n.name) = lower(r.name)) AS exists_flag FROM requested_names r
""")
def existence_flags(t):
    found = schema.exact_names(t["requested_names"], t.sql(TABLE_NAMES), "table_id")
    return found.select("req_id", "name", F.col("table_id").isNotNull().alias("exists_flag"))


@query("missing_objects", """
SELECT p_partkey AS table_id, 't' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_size > 45
""")
def missing_objects(t):
    recorded = t.sql(TABLE_NAMES)
    live = t["part"].filter("p_size <= 45").select(F.col("p_partkey").alias("table_id"))
    return schema.missing_objects(recorded, live, ["table_id"])


@query("classify_queries", "SELECT query_id, rg_name FROM grouped_audit")
def classify_queries(t):
    return grouped_log(t).select("query_id", "rg_name")


@query("big_query_violations", """
SELECT CAST(ts_start AS DATE) AS day, a.rg_name, count(*) AS n_queries,
  count(*) FILTER (WHERE scan_rows > nullif(big_query_scan_rows_limit, 0)) AS n_scan_rows,
  count(*) FILTER (WHERE mem_cost_bytes > nullif(big_query_mem_limit, 0)) AS n_mem,
  count(*) FILTER (WHERE cpu_cost_ns / 1e9 > nullif(big_query_cpu_second_limit, 0)) AS n_cpu
FROM grouped_audit a LEFT JOIN resource_groups g ON g.rg_name = a.rg_name GROUP BY 1, 2
""")
def big_query_violations(t):
    return workload.big_query_violations(grouped_log(t), t["resource_groups"])


@query("group_limits", """
SELECT rg_name, arg_min(mem_limit, listed) FILTER (WHERE mem_limit <> '') AS mem_limit,
  arg_min(concurrency_limit, listed) FILTER (WHERE concurrency_limit <> 0) AS concurrency_limit,
  arg_min(big_query_scan_rows_limit, listed) FILTER (WHERE big_query_scan_rows_limit <> 0) AS big_query_scan_rows_limit
FROM group_listing GROUP BY 1
""")
def group_limits(t):
    """The limits of each group of a listing that has a row per classifier."""
    return workload.fold_group_rows(t["group_listing"], "listed")


@query("variable_drift", """
SELECT name, status, CASE WHEN status <> 'ok' THEN 'SET GLOBAL ' || name || ' = ''' || replace(desired, '''', '''''') || '''' END AS stmt
FROM (SELECT *, CASE WHEN actual IS NULL THEN 'missing'
  WHEN CASE lower(desired) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE desired END
     = CASE lower(actual) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE actual END THEN 'ok' ELSE 'changed' END AS status FROM variables) AS v
""")
def variable_drift(t):
    return schema.variable_drift(t["variables"])


@query("index_rule_violations", """
WITH defs AS (SELECT * FROM index_defs)
SELECT table_id, index_name, column_name, 'TABLE_MISSING' AS reason FROM defs WHERE table_id NOT IN (SELECT table_id FROM actual_columns)
UNION ALL
SELECT d.table_id, d.index_name, d.column_name, 'COLUMN_MISSING' FROM defs d WHERE d.table_id IN (SELECT table_id FROM actual_columns)
  AND NOT EXISTS (SELECT 1 FROM actual_columns c WHERE c.table_id = d.table_id AND c.name = d.column_name)
UNION ALL
SELECT table_id, index_name, column_name, 'COLUMN_INDEXED_TWICE' FROM defs QUALIFY count(*) OVER (PARTITION BY table_id, column_name) > 1
UNION ALL
SELECT table_id, index_name, column_name, 'NAME_REUSED' FROM defs QUALIFY count(*) OVER (PARTITION BY table_id, index_name) > 1
""")
def index_rule_violations(t):
    return schema.index_rule_violations(t["index_defs"], t["actual_columns"])


@query("setting_in_force", """
SELECT e.event_id, e.user_id, s.event_id AS signup_id, s.ts AS signup_at, s.value AS signup_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') AS e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') AS s ON e.user_id = s.user_id AND e.ts >= s.ts
""")
def setting_in_force(t):
    events = t["events"]
    asked = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = events.filter("event_type = 'signup'").select(
        "user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value")
    )
    found = ordered.as_of(asked, facts, ["user_id"], "ts", ["signup_id", "signup_value"], F.date_trunc("hour", "ts"))
    return found.select("event_id", "user_id", "signup_id", F.col("fact_at").alias("signup_at"), "signup_value")


@query("overlapping_queries", """
WITH runs AS (SELECT query_id, user_name, ts_start, ts_start + to_milliseconds(query_time_ms) AS ts_end FROM audit WHERE query_time_ms > 0)
SELECT a.query_id, a.user_name, count(b.query_id) AS n_overlapping FROM runs a LEFT JOIN runs b
  ON a.user_name = b.user_name AND a.query_id <> b.query_id AND b.ts_start < a.ts_end AND a.ts_start < b.ts_end GROUP BY 1, 2
""")
def overlapping_queries(t):
    return workload.overlap_counts(t["audit"], ["user_name"]).select("query_id", "user_name", "n_overlapping")
