"""Loads and changes under the four key models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keymodels as km
from ..session import workdir
from ..sources import versions
from ..sources.layout import append_batch
from .registry import query

LINE_KEY = ["l_orderkey", "l_linenumber"]
VIEWS = {"views": "BIGINT SUM", "cents": "BIGINT SUM", "top": "BIGINT MAX", "low": "BIGINT MIN"}
FEED_ORDER = ("seq1", "seq2", "seq3", "seq4")


def event_measures(events):
    cents = F.floor(F.col("value") * 100)
    return events.select(
        F.to_date("ts").alias("day"), "event_type", F.lit(1).cast("bigint").alias("views"),
        cents.alias("cents"), cents.alias("top"), cents.alias("low"),
    )


def feed_order():
    """Feed order; of rows equal in it, the lower price counts as the later one."""
    return [*map(F.col, FEED_ORDER), -F.col("new_price")]


EVENT_DAYS = """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS views, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents,
  max(CAST(floor(value * 100) AS BIGINT)) AS top, min(CAST(floor(value * 100) AS BIGINT)) AS low
FROM events GROUP BY 1, 2
"""

LAST_CHANGE = """
SELECT part_key, op, new_price FROM (SELECT *, row_number() OVER (PARTITION BY part_key
  ORDER BY seq1 DESC, seq2 DESC, seq3 DESC, seq4 DESC, new_price, op) AS rn FROM change_feed) AS f WHERE rn = 1
"""


@query("duplicate_key_append", "SELECT * FROM lineitem")
def duplicate_key_append(t):
    path = workdir(t.spark, "duplicate-key")
    lines = t["lineitem"]
    append_batch(lines.filter("l_linestatus = 'O'"), path, LINE_KEY)
    append_batch(lines.filter("l_linestatus IS DISTINCT FROM 'O'"), path, LINE_KEY)
    return t.spark.read.parquet(path)


@query("aggregate_key_rollup", EVENT_DAYS)
def aggregate_key_rollup(t):
    return km.aggregate_key(event_measures(t["events"]), ["day", "event_type"], VIEWS)


@query("aggregate_key_merge", EVENT_DAYS)
def aggregate_key_merge(t):
    keys, events = ["day", "event_type"], t["events"]
    halves = [events.filter("value < 50"), events.filter("value >= 50 OR value IS NULL")]
    return km.merge_aggregates([km.aggregate_key(event_measures(h), keys, VIEWS) for h in halves], keys, VIEWS)


@query("unique_key_latest", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
  l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) AS r WHERE rn = 1
""")
def unique_key_latest(t):
    return km.latest_per_key(t["lineitem"], LINE_KEY, ["l_shipdate"])


@query("change_feed_apply", f"SELECT part_key, new_price FROM ({LAST_CHANGE}) AS l WHERE op = 'U'")
def change_feed_apply(t):
    return km.apply_change_feed(t["change_feed"], ["part_key"], feed_order(), ["new_price"])


@query("primary_key_upsert", f"""
SELECT coalesce(p.p_partkey, l.part_key) AS p_partkey, p.p_name AS p_name, p.p_size AS p_size,
  CASE WHEN l.op IS NULL THEN p.p_retailprice ELSE CAST(l.new_price AS DOUBLE) END AS p_retailprice
FROM part p FULL OUTER JOIN ({LAST_CHANGE}) AS l ON p.p_partkey = l.part_key WHERE l.op IS DISTINCT FROM 'D'
""")
def primary_key_upsert(t):
    base = t["part"].select("p_partkey", "p_name", "p_size", "p_retailprice")
    folded = km.fold_changes(t["change_feed"], ["part_key"], feed_order(), ["new_price"])
    changes = folded.select(F.col("part_key").alias("p_partkey"), "op", F.col("new_price").cast("double").alias("p_retailprice"))
    table = workdir(t.spark, "parts")
    versions.commit(base, table)
    versions.commit(km.upsert(versions.read(t.spark, table), changes, ["p_partkey"]), table)
    return versions.read(t.spark, table)


@query("partition_retention", """
SELECT event_id, CAST(ts AS DATE) AS day, user_id, value FROM events WHERE CAST(ts AS DATE) IN
  (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 7)
""")
def partition_retention(t):
    rows = t["events"].select("event_id", F.to_date("ts").alias("day"), "user_id", "value")
    return km.newest_partitions(rows, "day", 7).select(*rows.columns)


@query("key_violations", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
  CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'NULL_KEY' ELSE 'DUPLICATE_KEY' END AS reason
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL
""")
def key_violations(t):
    return km.key_violations(t["lineitem"], LINE_KEY)
