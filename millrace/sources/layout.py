"""Physical layout of written tables: partitions, buckets, order, codec, skipping."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that one bucket or file holds, where the caller does not say.
ROWS_EACH = 5_000_000


def parts_for(df: DataFrame, rows_each: int = ROWS_EACH) -> int:
    """How many buckets or files the rows fill."""
    return max(1, -(-df.count() // rows_each))


def write_bucketed(df: DataFrame, path: str, partition: str, bucket: str, n: int, order: list[str]) -> str:
    """Partitioned, hash-bucketed, key-sorted external table; gives its name.

    Range partitioning before the write spreads a hot partition over many tasks and
    keeps the files per task few.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    placed = df.repartitionByRange(partition, *order)
    writer = placed.write.partitionBy(partition).bucketBy(n, bucket).sortBy(*order)
    writer.option("path", path).format("parquet").saveAsTable(name)
    return name


def write_even(df: DataFrame, path: str, files: int) -> None:
    """No distribution key: rows go round robin to this many files."""
    df.repartition(files).write.parquet(path)


def write_sorted(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists", **options) -> None:
    """Range-partitioned and sorted by the key columns, so file ranges do not overlap."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).mode(mode).parquet(path)


def append_batch(df: DataFrame, path: str, order: list[str]) -> None:
    """DUPLICATE KEY load: rows added unchanged, sorted by key inside each file."""
    df.sortWithinPartitions(*order).write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition: str, order: list[str]) -> None:
    df.repartitionByRange(partition, *order).write.partitionBy(partition).parquet(path)


def bloom_options(column: str, fpp: float, distinct: int) -> dict[str, str]:
    """Writer options for a parquet bloom filter on one column."""
    if not 0 < fpp < 1:
        raise ValueError("the false-positive rate lies between 0 and 1")
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.fpp#{column}": str(fpp),
        f"parquet.bloom.filter.expected.ndv#{column}": str(distinct),
    }


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, n_rows) of a written table."""
    return spark.read.parquet(path).groupBy("_metadata.file_name").agg(F.count(F.lit(1)).alias("n_rows"))


def overlapping_files(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(n_files, n_overlapping): files whose first value of the column lies before the last one's of the file before.

    The window sees one row a file.
    """
    files = spark.read.parquet(path).groupBy("_metadata.file_name").agg(F.min(column).alias("low"), F.max(column).alias("high"))
    line = W.partitionBy().orderBy("low", "high")
    return files.withColumn("before", F.max("high").over(line.rowsBetween(W.unboundedPreceding, -1))).agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("low") < F.col("before")).alias("n_overlapping")
    )


def storage_usage(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, files that hold rows, and their bytes, per table; the scan reads no column."""
    parts = []
    for name, df in tables.items():
        files = df.groupBy("_metadata.file_path").agg(F.max("_metadata.file_size").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
        parts.append(files.select(F.lit(name).alias("table_name"), "n_rows", "n_bytes"))
    used = reduce(DataFrame.unionAll, parts).groupBy("table_name")
    return used.agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def bucket_rows(table: DataFrame, n: int) -> DataFrame:
    """(bucket, n_rows, skew) of a bucketed table's files; the skew compares a bucket with the mean."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    bucket = F.regexp_extract(name, r"_(\d+)(?:\.c\d+)?\.[^/]*$", 1).cast("int").alias("bucket")
    counts = table.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_rows"))
    mean = F.sum("n_rows").over(W.partitionBy()) / n  # over at most n bucket rows
    return counts.select("bucket", "n_rows", (F.col("n_rows") / mean).alias("skew"))
