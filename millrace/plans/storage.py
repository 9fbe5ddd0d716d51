"""Sources and sinks: several formats as one, and layouts written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import workdir
from ..sources import external, layout
from .inputs import BASE
from .registry import query


@query("federated_join", """
SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
""")
def federated_join(t):
    root = workdir(t.spark, "federated")
    t["orders"].write.orc(f"{root}/orders")
    t["customer"].write.json(f"{root}/customer")
    specs = {
        "orders": {"type": "orc", "path": f"{root}/orders"},
        "customer": {"type": "json", "path": f"{root}/customer", "schema": t["customer"].schema},
        "nation": {"type": "parquet", "path": t.path("nation")},
    }
    orders, customer, nation = (external.read_source(t.spark, specs[n]) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue")
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), revenue)


@query("unified_union", """
SELECT *, CASE o_orderstatus WHEN 'F' THEN 'lake_a' WHEN 'O' THEN 'lake_b' ELSE 'lake_c' END AS source_name FROM orders
""")
def unified_union(t):
    root, orders = workdir(t.spark, "unified"), t["orders"]
    orders.filter("o_orderstatus = 'F'").write.parquet(f"{root}/a")
    orders.filter("o_orderstatus = 'O'").write.orc(f"{root}/b")
    orders.filter("coalesce(o_orderstatus, '') NOT IN ('F', 'O')").write.json(f"{root}/c")
    return external.unified(t.spark, {
        "lake_a": {"type": "parquet", "path": f"{root}/a"},
        "lake_b": {"type": "orc", "path": f"{root}/b"},
        "lake_c": {"type": "json", "path": f"{root}/c", "schema": orders.schema},
    })


#: Small, so that the given tables fill several buckets and files.
ROWS_EACH = 20_000

AUDIT_DAYS = "SELECT *, CAST(ts_start AS DATE) AS day FROM audit"


@query("partitioned_bucketed_roundtrip", f"""
SELECT query_id, count(*) AS n_rows, min(day) AS day, CAST(sum(scan_rows) AS BIGINT) AS scan_rows FROM ({AUDIT_DAYS}) AS a GROUP BY 1
""")
def partitioned_bucketed_roundtrip(t):
    """Grouping by the bucket column reads back without a shuffle."""
    audit = t["audit"].withColumn("day", F.to_date("ts_start"))
    name = layout.write_bucketed(audit, workdir(t.spark, "bucketed"), "day", "query_id", layout.parts_for(audit, ROWS_EACH), ["ts_start", "query_id"])
    table = t.spark.table(name).groupBy("query_id")
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("day"), F.sum("scan_rows").alias("scan_rows"))


@query("random_bucket_roundtrip", "SELECT * FROM events")
def random_bucket_roundtrip(t):
    path = workdir(t.spark, "even")
    layout.write_even(t["events"], path, layout.parts_for(t["events"], ROWS_EACH))
    return t.spark.read.parquet(path)


@query("random_bucket_spread", f"SELECT greatest(1, CAST(ceil(count(*) / {ROWS_EACH}) AS BIGINT)) AS n_files, count(*) AS n_rows, TRUE AS even FROM events")
def random_bucket_spread(t):
    """Do the files hold as many rows each, but for what one task's turn can add?"""
    path = workdir(t.spark, "even")
    layout.write_even(t["events"], path, layout.parts_for(t["events"], ROWS_EACH))
    rows = F.col("n_rows")
    even = F.max(rows) - F.min(rows) <= t["events"].rdd.getNumPartitions()
    return layout.rows_per_file(t.spark, path).agg(F.count(F.lit(1)).alias("n_files"), F.sum(rows).alias("n_rows"), even.alias("even"))


@query("key_sorted_ranges", "SELECT CAST(0 AS BIGINT) AS n_overlapping, count(*) > 0 AS written FROM lineitem")
def key_sorted_ranges(t):
    """Files of a key-sorted table whose key ranges overlap: none."""
    path = workdir(t.spark, "sorted")
    layout.write_sorted(t["lineitem"], path, ["l_orderkey", "l_linenumber"])
    return layout.overlapping_files(t.spark, path, "l_orderkey").select("n_overlapping", (F.col("n_files") > 0).alias("written"))


@query("compressed_codec", "SELECT 'lz4' AS codec, count(*) AS n_rows FROM events")
def compressed_codec(t):
    """The codec that the written files name."""
    path = workdir(t.spark, "lz4")
    t["audit"].write.option("compression", "lz4").parquet(path)
    codec = F.regexp_extract("file_name", r"\.(lz4)[a-z_]*\.parquet$", 1)
    return layout.rows_per_file(t.spark, path).groupBy(codec.alias("codec")).agg(F.sum("n_rows").alias("n_rows"))


@query("compressed_roundtrip", AUDIT_DAYS)
def compressed_roundtrip(t):
    path = workdir(t.spark, "lz4")
    audit = t["audit"].withColumn("day", F.to_date("ts_start"))
    audit.write.option("compression", "lz4").parquet(path)
    return t.spark.read.parquet(path)


@query("storage_usage")
def storage_usage(t):
    """Rows, files and bytes of every given table."""
    return layout.storage_usage({name: t[name] for name in BASE})


@query("storage_rows", " UNION ALL ".join(f"SELECT '{name}' AS table_name, count(*) AS n_rows, count(*) > 0 AS stored FROM {name}" for name in BASE))
def storage_rows(t):
    """Do the files of each table hold all of its rows?"""
    return layout.storage_usage({name: t[name] for name in BASE}).select("table_name", "n_rows", ((F.col("n_bytes") > 0) & (F.col("n_files") > 0)).alias("stored"))


# The hash by which Spark deals rows to buckets: each half of a number is mixed in, then all is mixed once more.
def _mixed(half, seed):
    return f"""{half} * 3432918353::UBIGINT & m AS {half}1, (({half}1 << 15) | ({half}1 >> 17)) & m AS {half}2, {half}2 * 461845907::UBIGINT & m AS {half}3,
  xor({seed}, {half}3) AS {half}4, (({half}4 << 13) | ({half}4 >> 19)) & m AS {half}5, ({half}5 * 5 + 3864292196::UBIGINT) & m AS {half}6"""


BUCKETS = 8


@query("bucket_skew", f"""
SELECT bucket, n_rows, n_rows / (sum(n_rows) OVER () / {BUCKETS}) AS skew FROM (
  SELECT CAST(f5 % {BUCKETS} AS INTEGER) AS bucket, count(*) AS n_rows FROM (
    SELECT 4294967295::UBIGINT AS m, CAST(user_id & 4294967295 AS UBIGINT) AS lo, CAST((user_id >> 32) & 4294967295 AS UBIGINT) AS hi,
      {_mixed("lo", "42::UBIGINT")}, {_mixed("hi", "lo6")}, xor(hi6, 8::UBIGINT) AS f0,
      xor(f0, f0 >> 16) * 2246822507::UBIGINT & m AS f2, xor(f2, f2 >> 13) * 3266489909::UBIGINT & m AS f4, xor(f4, f4 >> 16) AS f5
    FROM events) AS h GROUP BY 1) AS b
""")
def bucket_skew(t):
    """Rows in each bucket of a written table, and how far the bucket is above the mean."""
    events = t["events"].withColumn("day", F.to_date("ts"))
    name = layout.write_bucketed(events, workdir(t.spark, "skew"), "day", "user_id", BUCKETS, ["ts", "event_id"])
    return layout.bucket_rows(t.spark.table(name), BUCKETS)


@query("bloom_skipping", """SELECT event_id, user_id, event_type, value FROM events WHERE props = '{"k": 69}'""")
def bloom_skipping(t):
    path = workdir(t.spark, "bloom")
    distinct = t["events"].agg(F.approx_count_distinct("props")).first()[0]
    t["events"].write.options(**layout.bloom_options("props", 0.05, max(1, distinct))).parquet(path)
    return t.spark.read.parquet(path).filter(F.col("props") == '{"k": 69}').select("event_id", "user_id", "event_type", "value")
