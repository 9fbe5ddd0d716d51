"""Statement text for databases, indexes, catalogs and resource groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ddl import render_properties
from .quoting import quote

# Classifier column → how its condition is written.
CONDITION_FORMATS = {
    "user_name": "user='%s'",
    "role_name": "role='%s'",
    "query_type": "query_type in ('%s')",
    "source_ip": "source_ip='%s'",
    "db": "db='%s'",
}

# Resource group properties in the order they are written.
GROUP_PROPERTIES = (
    "cpu_weight", "exclusive_cpu_cores", "cpu_core_limit", "max_cpu_cores", "mem_limit", "concurrency_limit",
    "big_query_mem_limit", "big_query_scan_rows_limit", "big_query_cpu_second_limit",
)


def _ticked(name: Column) -> Column:
    return F.concat(F.lit("`"), name, F.lit("`"))


def _comment(comment: Column) -> Column:
    return F.when(comment != "", F.concat(F.lit("COMMENT "), quote(comment)))


def alter_database(df: DataFrame) -> DataFrame:
    """(db, step, stmt): one ALTER per quota or volume that is set."""
    name = F.col("db")
    head = F.concat(F.lit("ALTER DATABASE "), _ticked(name))
    volume = F.concat(F.lit("ALTER DATABASE "), quote(name), F.lit(' SET ("storage_volume" = '), quote(F.col("storage_volume")), F.lit(")"))
    statements = F.array(
        F.when(F.col("data_quota") != "", F.concat(head, F.lit(" SET DATA QUOTA "), F.col("data_quota"))),
        F.when(F.col("replica_quota") > 0, F.concat(head, F.lit(" SET REPLICA QUOTA "), F.col("replica_quota").cast("string"))),
        F.when(F.col("storage_volume") != "", volume),
    )
    return df.select("db", F.posexplode(statements).alias("step", "stmt")).filter("stmt IS NOT NULL")


def add_index(table: Column, name: Column, column: Column, kind: Column, props: Column, comment: Column) -> Column:
    return F.concat_ws(
        " ",
        F.lit("ALTER TABLE"), table, F.lit("ADD INDEX"), _ticked(name),
        F.concat(F.lit("("), _ticked(column), F.lit(")")), F.lit("USING"), kind,
        F.when(F.size(props) > 0, F.concat(F.lit("("), render_properties(props), F.lit(")"))),
        _comment(comment),
    )


def create_catalog(name: Column, comment: Column, props: Column) -> Column:
    return F.concat_ws(
        " ",
        F.lit("CREATE EXTERNAL CATALOG"), _ticked(name), _comment(comment),
        F.when(F.size(props) > 0, F.concat(F.lit("PROPERTIES ("), render_properties(props), F.lit(")"))),
    )


def create_resource_group(groups: DataFrame, classifiers: DataFrame) -> DataFrame:
    """(rg_name, stmt). A classifier without conditions is left out.

    The classifiers of one group end up in one text, in the order of their ids.
    """
    conditions = F.concat_ws(", ", *(F.when(F.col(c).isNotNull(), F.format_string(form, F.col(c))) for c, form in CONDITION_FORMATS.items()))
    rules = classifiers.select("rg_name", "classifier_id", conditions.alias("text")).filter("text <> ''")
    targets = rules.groupBy("rg_name").agg(F.array_sort(F.collect_list(F.struct("classifier_id", "text"))).alias("rules"))
    pairs = F.concat_ws(", ", *(
        F.when(F.col(p).isNotNull(), F.concat(F.lit(f"'{p}' = '"), F.col(p).cast("string"), F.lit("'")))
        for p in GROUP_PROPERTIES if p in groups.columns
    ))
    to = F.when(F.col("rules").isNotNull(), F.concat(F.lit("TO ("), F.array_join("rules.text", "), ("), F.lit(")")))
    stmt = F.concat_ws(
        " ", F.lit("CREATE RESOURCE GROUP"), _ticked(F.col("rg_name")), to,
        F.when(pairs != "", F.concat(F.lit("WITH ("), pairs, F.lit(")"))),
    )
    return groups.join(targets, "rg_name", "left").select("rg_name", stmt.alias("stmt"))
