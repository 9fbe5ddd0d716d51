"""Profiles and rule checks over the rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_or_null
from .schema import spark_type, text_limit

_SKETCH = "column_name string, n_rows bigint, n_null bigint, n_distinct bigint, min_value string, max_value string, max_length int, quartiles array<double>"


def column_profile(df: DataFrame, columns: list[str], min_share: float = 0.0001, min_distinct: int = 100) -> DataFrame:
    """Per column: nulls, distinct values, least and greatest value, longest text.

    Unpivoted and counted per (column, value) first, so the distinct count is a plain
    aggregate. ``bitmap_fit`` marks moderate to high cardinality.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    values = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    profile = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.max(F.length("value")).alias("max_length"),
    )
    # Least and greatest in the column's own order, not that of its text.
    ends = df.agg(*(f(c).cast("string").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("least", F.min), ("most", F.max))))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"least{i}").alias("min_value"), F.col(f"most{i}").alias("max_value")) for i, c in enumerate(columns)]
    profile = profile.join(ends.select(F.explode(F.array(*cells)).alias("c")).select("c.*"), "column_name")
    fit = (F.col("n_distinct") >= min_distinct) & (F.col("n_distinct") >= F.col("n_rows") * min_share)
    return profile.withColumn("bitmap_fit", fit)


def column_sketch(df: DataFrame, columns: list[str] | None = None, error: float = 0.02) -> DataFrame:
    """Per column of the schema: nulls, estimated distinct values, ends, quartiles of numbers, longest text.

    One pass and one row of sketches for each task: no cell is shuffled, however many
    columns and values there are. ``n_distinct`` has a relative standard error of
    ``error``; the quartiles' ranks are within a ten-thousandth of the rows. Columns
    of arrays, maps and structs have no order and are left out unless named.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c, kind in kinds.items() if isinstance(kind, T.AtomicType) and kind.typeName() != "variant"] if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], _SKETCH)
    aggregates, cells = [F.count(F.lit(1)).alias("n_rows")], []
    for i, name in enumerate(columns):
        col = F.col("`" + name.replace("`", "``") + "`")
        made = {
            "n_null": F.count_if(col.isNull()),
            "n_distinct": F.approx_count_distinct(col, error),
            "min_value": F.min(col).cast("string"),
            "max_value": F.max(col).cast("string"),
            "max_length": F.max(F.length(col.cast("string"))),
        }
        if isinstance(kinds[name], T.NumericType):
            made["quartiles"] = F.percentile_approx(col.cast("double"), [0.25, 0.5, 0.75], 10_000)
        aggregates += [agg.alias(f"{part}{i}") for part, agg in made.items()]
        quartiles = F.col(f"quartiles{i}") if "quartiles" in made else F.lit(None).cast("array<double>")
        parts = [F.col(f"{part}{i}").alias(part) for part in made if part != "quartiles"]
        cells.append(F.struct(F.lit(name).alias("column_name"), "n_rows", *parts, quartiles.alias("quartiles")))
    return df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def constraint_violations(df: DataFrame, spec: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows per column that break its spec (name, table type, nullable), in one pass.

    Counts nulls in a NOT NULL column, texts over VARCHAR(n), numbers a DECIMAL
    cannot hold and values that do not cast.
    """
    checks: list[tuple[str, str, Column]] = []
    for name, type_, nullable in spec:
        col = F.col(name)
        if not nullable:
            checks.append((name, "NOT_NULL", col.isNull()))
        target = spark_type(type_)
        if target == "string":
            if limit := text_limit(type_):
                checks.append((name, "LENGTH", F.length(col.cast("string")) > limit))
        else:
            rule = "RANGE" if target.startswith("decimal") else "CAST"
            checks.append((name, rule, col.isNotNull() & cast_or_null(col, df.schema[name].dataType, target).isNull()))
    if not checks:
        return df.sparkSession.createDataFrame([], "column_name string, rule string, n_rows bigint")
    totals = df.agg(*(F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)))
    cells = [
        F.struct(F.lit(n).alias("column_name"), F.lit(r).alias("rule"), F.col(f"c{i}").alias("n_rows"))
        for i, (n, r, _) in enumerate(checks)
    ]
    return totals.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
