"""Tables held elsewhere, read through one spec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared source type → Spark reader format. The lake and search
# formats need their package on the class path.
FORMATS = {
    "parquet": "parquet", "orc": "orc", "json": "json", "csv": "csv",
    "iceberg": "iceberg", "hudi": "hudi", "deltalake": "delta", "paimon": "paimon",
    "es": "org.elasticsearch.spark.sql", "jdbc": "jdbc",
}


def read_source(spark: SparkSession, spec: dict) -> DataFrame:
    """DataFrame of ``{type, path | table, schema, options}``.

    ``hive`` reads a metastore table. For ``jdbc`` the options should name
    partitionColumn, lowerBound, upperBound and numPartitions, else one task reads all.
    """
    kind = spec["type"]
    if kind == "hive":
        return spark.table(spec["table"])
    if kind not in FORMATS:
        raise ValueError(f"unknown source type {kind!r}")
    reader = spark.read.format(FORMATS[kind]).options(**spec.get("options", {}))
    if "schema" in spec:
        reader = reader.schema(spec["schema"])
    if kind == "jdbc":
        return reader.option("dbtable", spec["table"]).load()
    return reader.load(spec["path"])


def unified(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    """Several sources as one table, each row tagged with its source name."""
    parts = [read_source(spark, spec).withColumn("source_name", F.lit(name)) for name, spec in specs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
