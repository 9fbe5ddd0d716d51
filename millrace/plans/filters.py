"""Filters: equality, substring and partition predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import workdir
from ..sources.layout import write_partitioned
from .registry import query

KEYWORD = "estion"


@query("equality_filter", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def equality_filter(t):
    wanted = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t["orders"].filter(wanted).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("substring_search", f"SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%{KEYWORD}%'")
def substring_search(t):
    return t["documents"].filter(F.lower("text").contains(KEYWORD)).select("doc_id", "lang")


@query("partition_pruned_scan", """
SELECT query_id, CAST(ts_start AS DATE) AS day, db, scan_rows FROM audit WHERE CAST(ts_start AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-16'
""")
def partition_pruned_scan(t):
    path = workdir(t.spark, "by-day")
    write_partitioned(t["audit"].withColumn("day", F.to_date("ts_start")), path, "day", ["ts_start", "query_id"])
    days = F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-16").cast("date"))
    return t.spark.read.parquet(path).filter(days).select("query_id", "day", "db", "scan_rows")
