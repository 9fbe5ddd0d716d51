"""Versions of a written table: a log, written last, names the folders that count.

``<table>/data`` holds one folder a version, ``<table>/log`` one small file a version. A
rewrite first writes its folder and then its log entry, which the file system shows as a
whole or not at all; until then readers take the version before. A write that fails leaves
a folder that no entry names. One writer at a time: nothing here locks the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "version long, folder string, batch string, schema string"


def log(spark: SparkSession, table: str) -> DataFrame:
    """version, folder, batch and schema of the versions that count; one row each."""
    try:
        return spark.read.schema(LOG).parquet(f"{table}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def commit(df: DataFrame, table: str, batch: str | None = None) -> int:
    """Write the rows as the table's next version and return its number.

    A batch that has a name is committed once: a repeat of it writes nothing and returns
    the version it made.
    """
    spark, entries = df.sparkSession, log(df.sparkSession, table)
    last = entries.agg(F.max("version").alias("version"), F.max(F.when(F.col("batch") == batch, F.col("version"))).alias("same")).first()
    if last.same is not None:
        return last.same
    version = (last.version or 0) + 1
    folder = f"data/{version}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{folder}")
    entry = spark.createDataFrame([(version, folder, batch, df.schema.json())], LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{table}/log")
    return version


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest one if none is named, in the schema they were written in."""
    entries = log(spark, table)
    chosen = entries.filter(F.col("version") == version) if version is not None else entries.orderBy(F.col("version").desc()).limit(1)
    found = chosen.collect()
    if not found:
        raise ValueError(f"no version {version if version is not None else ''} of {table}")
    return spark.read.schema(T.StructType.fromJson(json.loads(found[0].schema))).parquet(f"{table}/{found[0].folder}")
