"""Statement text rendered for whole columns of definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statements, text
from ..operators import schema
from .registry import query
from .text import COLUMN_SQL, property_maps

NEW_COLUMN_SQL = (
    COLUMN_SQL.replace("type", "new_type").replace("nullable", "new_nullable").replace("dflt", "new_dflt").replace("|| comment", "|| new_comment")
    .replace("WHEN comment", "WHEN new_comment")
)


def table_name():
    return F.concat(F.lit("`db1`.`t"), F.col("table_id").cast("string"), F.lit("`"))


@query("render_alter_statements", f"""
SELECT table_id, CASE WHEN kind = 'DROP' THEN 0 ELSE 1 END AS phase, coalesce(d_ord, a_ord) AS step,
  'ALTER TABLE `db1`.`t' || CAST(table_id AS STRING) || '` ' || CASE kind WHEN 'DROP' THEN 'DROP COLUMN `' || name || '`'
  WHEN 'ADD' THEN 'ADD COLUMN ' || {NEW_COLUMN_SQL} ELSE 'MODIFY COLUMN ' || {NEW_COLUMN_SQL} END AS stmt FROM column_changes
UNION ALL
SELECT table_id, 2, 1, 'ALTER TABLE `db1`.`t' || CAST(table_id AS STRING) || '` COMMENT = "' || new_comment || '"'
FROM table_specs WHERE old_comment IS DISTINCT FROM new_comment AND new_comment IS NOT NULL
""")
def render_alter_statements(t):
    changes = schema.column_diff(t["desired_columns"], t["actual_columns"])
    comments = schema.comment_statements(t["table_specs"], table_name(), "old_comment", "new_comment")
    return schema.alter_statements(changes, table_name()).unionByName(comments)


@query("render_database_alters", """
SELECT db, 0 AS step, 'ALTER DATABASE `' || db || '` SET DATA QUOTA ' || data_quota AS stmt FROM database_specs WHERE data_quota <> ''
UNION ALL SELECT db, 1, 'ALTER DATABASE `' || db || '` SET REPLICA QUOTA ' || CAST(replica_quota AS VARCHAR) FROM database_specs WHERE replica_quota > 0
UNION ALL SELECT db, 2, 'ALTER DATABASE "' || db || '" SET ("storage_volume" = "' || storage_volume || '")' FROM database_specs WHERE storage_volume <> ''
""")
def render_database_alters(t):
    return statements.alter_database(t["database_specs"])


@query("render_index_statements", """
SELECT table_id, index_name, column_name, 'ALTER TABLE `db1`.`t' || CAST(table_id AS STRING) || '` ADD INDEX `' || index_name || '` (`' || column_name || '`) USING '
  || CASE WHEN contains(raw_type, '(') THEN 'NGRAMBF ("bloom_filter_fpp" = "0.05", "gram_num" = "4")' ELSE raw_type END
  || ' COMMENT "on ' || column_name || '"' AS stmt FROM index_defs
""")
def render_index_statements(t):
    kind, props = text.strip_index_type(F.col("raw_type"))
    comment = F.concat(F.lit("on "), F.col("column_name"))
    stmt = statements.add_index(table_name(), F.col("index_name"), F.col("column_name"), kind, props, comment)
    return t["index_defs"].select("table_id", "index_name", "column_name", stmt.alias("stmt"))


@query("render_catalog_statements", """
SELECT 'cat_' || CAST(table_id AS STRING) AS name, 'CREATE EXTERNAL CATALOG `cat_' || CAST(table_id AS STRING) || '` COMMENT "lake"'
  || CASE WHEN count(recorded) > 0 THEN ' PROPERTIES (' || string_agg('"' || k || '" = "' || recorded || '"', ', ' ORDER BY k) || ')' ELSE '' END AS stmt
FROM property_pairs GROUP BY table_id
""")
def render_catalog_statements(t):
    named = property_maps(t["property_pairs"]).withColumn("name", F.concat(F.lit("cat_"), F.col("table_id").cast("string")))
    return named.select("name", statements.create_catalog(F.col("name"), F.lit("lake"), F.col("recorded")).alias("stmt"))


@query("render_group_statements", """
WITH rules AS (SELECT rg_name, string_agg('(' || rule || ')', ', ' ORDER BY classifier_id) AS target FROM (
  SELECT rg_name, classifier_id, concat_ws(', ', 'user=''' || user_name || '''', 'role=''' || role_name || '''',
    'query_type in (''' || query_type || ''')', 'source_ip=''' || source_ip || '''', 'db=''' || db || '''') AS rule FROM group_rules) AS r
  WHERE rule <> '' GROUP BY 1)
SELECT g.rg_name, 'CREATE RESOURCE GROUP `' || g.rg_name || '`' || coalesce(' TO ' || r.target, '') || ' WITH (' || concat_ws(', ',
  '''mem_limit'' = ''' || mem_limit || '''', '''concurrency_limit'' = ''' || CAST(concurrency_limit AS VARCHAR) || '''') || ')' AS stmt
FROM group_specs g LEFT JOIN rules r ON r.rg_name = g.rg_name
""")
def render_group_statements(t):
    return statements.create_resource_group(t["group_specs"], t["group_rules"])
