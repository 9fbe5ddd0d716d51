"""Declared against actual: column changes, replacement plans, drift and existence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.casts import cast_or_null
from ..functions.ddl import column_ddl, normalise_type, value_type
from ..functions.quoting import quote
from ..functions.text import normal_setting, set_statement
from ..sources import versions

ATTRIBUTES = ("ord", "type", "nullable", "dflt", "comment")


def _unset(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def column_diff(desired: DataFrame, actual: DataFrame, key: str = "table_id") -> DataFrame:
    """ADD / DROP / MODIFY rows of all tables in one full outer equi join.

    Names match by case, types without case; unset and empty text are equal; the
    order of columns does not count.
    """
    new = desired.select(key, "name", *(F.col(a).alias(f"new_{a}") for a in ATTRIBUTES))
    old = actual.select(key, "name", *(F.col(a).alias(f"old_{a}") for a in ATTRIBUTES))
    changed = (
        (F.upper("new_type") != F.upper("old_type"))
        | (F.col("new_nullable") != F.col("old_nullable"))
        | (_unset(F.col("new_dflt")) != _unset(F.col("old_dflt")))
        | (_unset(F.col("new_comment")) != _unset(F.col("old_comment")))
    )
    kind = F.when(F.col("old_ord").isNull(), "ADD").when(F.col("new_ord").isNull(), "DROP").when(changed, "MODIFY")
    return new.join(old, [key, "name"], "full").withColumn("kind", kind).filter("kind IS NOT NULL")


def alter_statements(changes: DataFrame, table: Column, key: str = "table_id") -> DataFrame:
    """The ALTER text of each change with its place in the run order.

    Drops come first in the old column order, then adds and modifies in the new
    one; (phase, step) sorts a table's statements.
    """
    definition = column_ddl(*(F.col(c) for c in ("name", "new_type", "new_nullable", "new_dflt", "new_comment")))
    action = (
        F.when(F.col("kind") == "DROP", F.concat(F.lit("DROP COLUMN `"), F.col("name"), F.lit("`")))
        .when(F.col("kind") == "ADD", F.concat(F.lit("ADD COLUMN "), definition))
        .otherwise(F.concat(F.lit("MODIFY COLUMN "), definition))
    )
    return changes.select(
        key,
        F.when(F.col("kind") == "DROP", 0).otherwise(1).alias("phase"),
        F.coalesce("new_ord", "old_ord").alias("step"),
        F.concat(F.lit("ALTER TABLE "), table, F.lit(" "), action).alias("stmt"),
    )


def comment_statements(specs: DataFrame, table: Column, old: str, new: str, key: str = "table_id") -> DataFrame:
    """The ALTER text of each changed table comment; it runs after the columns."""
    changed = specs.filter(F.col(new).isNotNull() & ~F.col(old).eqNullSafe(F.col(new)))
    stmt = F.concat(F.lit("ALTER TABLE "), table, F.lit(" COMMENT = "), quote(F.col(new)))
    return changed.select(key, F.lit(2).alias("phase"), F.lit(1).alias("step"), stmt.alias("stmt"))


def replacement_plan(specs: DataFrame, changes: DataFrame, replacing: list[tuple[str, str]], in_place: list[tuple[str, str]], key: str = "table_id") -> DataFrame:
    """NO_OP, IN_PLACE or REPLACE per table.

    A change of a replacing attribute forces REPLACE unless nothing was recorded
    before; a changed comment or column is done in place.
    """
    replaced = reduce(lambda a, b: a | b, [F.col(old).isNotNull() & ~F.col(old).eqNullSafe(F.col(new)) for old, new in replacing])
    edited = reduce(lambda a, b: a | b, [~F.col(old).eqNullSafe(F.col(new)) for old, new in in_place])
    touched = changes.groupBy(key).agg(F.count(F.lit(1)).alias("n_changes"))
    joined = specs.join(touched, key, "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0).cast("bigint")))
    plan = F.when(replaced, "REPLACE").when(edited | (F.col("n_changes") > 0), "IN_PLACE").otherwise("NO_OP")
    return joined.select(key, plan.alias("plan"), "n_changes")


def exact_names(requested: DataFrame, names: DataFrame, found: str, order: str | None = None) -> DataFrame:
    """Requested names with the object of the same name but for case, or null.

    LIKE would take ``_`` and ``%`` as wildcards, so it is no equality. Of several
    matches the last one by ``order`` (if not given, by ``found``) counts.
    """
    known = names.groupBy(F.lower("name").alias("folded")).agg(F.max_by(found, order or found).alias(found))
    return requested.withColumn("folded", F.lower("name")).join(known, "folded", "left").drop("folded")


def missing_objects(recorded: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded objects that are gone and have to be made again."""
    return recorded.join(live.select(*keys), keys, "left_anti")


def index_rule_violations(defs: DataFrame, columns: DataFrame, key: str = "table_id") -> DataFrame:
    """Index definitions that break a rule, one row per definition and reason.

    Tables and columns each join once; repeated names are counted over the definitions
    of one table.
    """
    tables = columns.select(F.col(key).alias("known_table")).distinct()
    placed = columns.select(F.col(key).alias("column_table"), F.col("name").alias("known_column")).distinct()
    per_column = W.partitionBy(key, "column_name")
    per_name = W.partitionBy(key, "index_name")
    checked = (
        defs.withColumns({"same_column": F.count(F.lit(1)).over(per_column), "same_name": F.count(F.lit(1)).over(per_name)})
        .join(tables, F.col(key) == F.col("known_table"), "left")
        .join(placed, (F.col(key) == F.col("column_table")) & (F.col("column_name") == F.col("known_column")), "left")
    )
    reasons = F.array(
        F.when(F.col("known_table").isNull(), "TABLE_MISSING"),
        F.when(F.col("known_table").isNotNull() & F.col("known_column").isNull(), "COLUMN_MISSING"),
        F.when((F.col("same_column") > 1) & F.col("column_name").isNotNull(), "COLUMN_INDEXED_TWICE"),
        F.when((F.col("same_name") > 1) & F.col("index_name").isNotNull(), "NAME_REUSED"),
    )
    return checked.select(key, "index_name", "column_name", F.explode(F.array_compact(reasons)).alias("reason"))


def variable_drift(settings: DataFrame) -> DataFrame:
    """ok / changed / missing per setting, with the text that would set it."""
    same = normal_setting(F.col("desired")) == normal_setting(F.col("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(same, "ok").otherwise("changed")
    return settings.select("name", status.alias("status"), F.when(status != "ok", set_statement(F.col("name"), F.col("desired"))).alias("stmt"))


# Table type → Spark type.
SPARK_TYPES = {
    "TINYINT": "tinyint", "SMALLINT": "smallint", "INT": "int", "BIGINT": "bigint",
    "LARGEINT": "decimal(38,0)", "STRING": "string", "DOUBLE": "double", "FLOAT": "float",
    "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz",
}


_ARRAY = re.compile(r"ARRAY\s*<(.+)>$", re.IGNORECASE)


def spark_type(type_text: str) -> str:
    """Spark type of a canonical table type; DECIMAL keeps its numbers, `text_limit` has those of texts."""
    base = type_text.upper().strip()
    if base.startswith(("VARCHAR", "CHAR")):
        return "string"
    if base.startswith("DECIMAL"):
        return base.lower().replace(" ", "")
    if array := _ARRAY.match(base):
        return f"array<{spark_type(array[1])}>"
    if base not in SPARK_TYPES:
        raise ValueError(f"no Spark type for {type_text!r}")
    return SPARK_TYPES[base]


def text_limit(type_text: str) -> int | None:
    """n of VARCHAR(n) or CHAR(n), also inside an ARRAY."""
    found = re.search(r"\b(?:VAR)?CHAR\s*\(\s*(\d+)\s*\)", type_text.upper())
    return int(found[1]) if found else None


def _converted(df: DataFrame, name: str, type_text: str) -> Column:
    """The column in its new type; null where a value does not cast or is too long."""
    value, limit = cast_or_null(F.col(name), df.schema[name].dataType, spark_type(type_text)), text_limit(type_text)
    if limit is None:
        return value
    fits = F.forall(value, lambda x: F.coalesce(F.length(x) <= limit, F.lit(True))) if _ARRAY.match(type_text.strip()) else F.length(value) <= limit
    return F.when(fits, value)


def typed_changes(changes: DataFrame) -> list[dict]:
    """The change rows of one table, in column order.

    They number at most the columns of that table, so the driver may hold them.
    """
    canonical = value_type(normalise_type(F.col("new_type")))
    rows = changes.select("kind", "name", canonical.alias("type"), "new_dflt", "new_ord").orderBy("new_ord").collect()
    return [r.asDict() for r in rows]


def apply_schema_change(df: DataFrame, changes: list[dict]) -> DataFrame:
    """The data after the changes: one projection, so the scan reads kept columns only.

    A value that does not fit a new type, or is longer than VARCHAR(n) allows, becomes
    null; `cast_failures` counts them.
    """
    dropped = {c["name"] for c in changes if c["kind"] == "DROP"}
    modified = {c["name"]: c["type"] for c in changes if c["kind"] == "MODIFY"}
    columns = []
    for name in df.columns:
        if name in modified:
            columns.append(_converted(df, name, modified[name]).alias(name))
        elif name not in dropped:
            columns.append(F.col(name))
    for c in changes:
        if c["kind"] == "ADD":
            columns.append(F.lit(c["new_dflt"]).try_cast(spark_type(c["type"])).alias(c["name"]))
    return df.select(*columns)


def write_version(table: str, spark: SparkSession, changes: list[dict]) -> int:
    """Rewrite the newest version of a table with the changes as its next version.

    It counts once its write has committed: a failed rewrite leaves the table as it was.
    """
    return versions.commit(apply_schema_change(versions.read(spark, table), changes), table)


def cast_failures(df: DataFrame, changes: list[dict]) -> DataFrame:
    """Per modified column: values, and values the new type cannot hold."""
    modified = {c["name"]: c["type"] for c in changes if c["kind"] == "MODIFY"}
    if not modified:
        return df.sparkSession.createDataFrame([], "column_name string, n_values bigint, n_lost bigint")
    sums = []
    for name, type_ in modified.items():
        lost = F.col(name).isNotNull() & _converted(df, name, type_).isNull()
        sums += [F.count(name).alias(f"{name}_n"), F.count_if(lost).alias(f"{name}_lost")]
    totals = df.agg(*sums)
    cells = [F.struct(F.lit(n).alias("column_name"), F.col(f"{n}_n").alias("n_values"), F.col(f"{n}_lost").alias("n_lost")) for n in modified]
    return totals.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def fill_defaults(batch: DataFrame, defaults: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds the columns a batch lacks with their default; explicit nulls stay null."""
    absent = {c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in batch.columns}
    return batch.withColumns(absent) if absent else batch
