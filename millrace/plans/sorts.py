"""Sorted layout and top-k reports."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import workdir
from ..sources.layout import write_sorted
from .joins import grouped_log
from .registry import query


@query("key_sorted_layout", "SELECT * FROM lineitem")
def key_sorted_layout(t):
    path = workdir(t.spark, "key-sorted")
    write_sorted(t["lineitem"], path, ["l_orderkey", "l_linenumber"])
    return t.spark.read.parquet(path)


@query("slowest_queries", "SELECT query_id, user_name, query_time_ms FROM audit ORDER BY query_time_ms DESC, query_id LIMIT 20")
def slowest_queries(t):
    return t["audit"].select("query_id", "user_name", "query_time_ms").orderBy(F.col("query_time_ms").desc(), "query_id").limit(20)


@query("topk_per_group", """
SELECT rg_name, query_id, cpu_cost_ns, rn FROM (SELECT rg_name, query_id, cpu_cost_ns,
  CAST(row_number() OVER (PARTITION BY rg_name ORDER BY cpu_cost_ns DESC, query_id) AS INTEGER) AS rn FROM grouped_audit) AS r WHERE rn <= 5
""")
def topk_per_group(t):
    """The rank limit is also applied before the shuffle, so a hot group sends k rows per task."""
    order = W.partitionBy("rg_name").orderBy(F.col("cpu_cost_ns").desc(), "query_id")
    rows = grouped_log(t).select("rg_name", "query_id", "cpu_cost_ns")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn <= 5")
