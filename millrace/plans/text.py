"""DDL text, property maps and scalar rules over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ddl, text
from ..operators import schema
from ..session import workdir
from ..sources import versions
from .registry import query


@query("ddl_parse_columns", "SELECT table_id, ord, name, type, nullable, dflt, comment FROM actual_columns")
def ddl_parse_columns(t):
    return ddl.parse_columns(t["ddl_corpus"], "table_id", "ddl")


@query("ddl_parse_tables", """
SELECT p_partkey AS table_id, 't' || CAST(p_partkey AS STRING) AS name, 'OLAP' AS engine,
  CASE WHEN p_partkey % 4 = 0 THEN 'PRIMARY KEY' WHEN p_partkey % 4 = 1 THEN 'UNIQUE KEY' ELSE 'DUPLICATE KEY' END AS key_type,
  CASE WHEN p_partkey % 4 < 2 THEN 'id' ELSE 'id,ts' END AS key_columns,
  CASE WHEN p_partkey % 6 = 0 THEN 'PARTITION BY date_trunc(''day'', `ts`)' END AS partition_by,
  'DISTRIBUTED BY HASH(`id`) BUCKETS ' || CAST(p_size AS STRING) AS distributed_by, p_name AS comment,
  CAST(1 + p_partkey % 3 AS STRING) AS replication_num, 'LZ4' AS compression FROM part
""")
def ddl_parse_tables(t):
    tables = ddl.parse_tables(t["ddl_corpus"], "table_id", "ddl")
    return tables.select(
        "table_id", "name", "engine", "key_type", F.array_join("key_columns", ",").alias("key_columns"),
        "partition_by", "distributed_by", "comment",
        F.col("properties")["replication_num"].alias("replication_num"), F.col("properties")["compression"].alias("compression"),
    )


@query("normalise_types", r"""
WITH canonical AS (SELECT id, regexp_replace(upper(trim(raw_type)), '^(TINYINT|SMALLINT|INT|BIGINT|LARGEINT)\(\d+\)(\s|$)', '\1\2') AS type FROM batch_types)
SELECT id, type, CASE WHEN type LIKE '% SUM' THEN replace(type, ' SUM', '') ELSE type END AS value_type,
  CASE WHEN type LIKE '% SUM' THEN 'SUM' END AS aggregate FROM canonical
""")
def normalise_types(t):
    canonical = t["batch_types"].select("id", ddl.normalise_type(F.col("raw_type")).alias("type"))
    kind = ddl.aggregate_kind(F.col("type"))
    return canonical.select("id", "type", ddl.value_type(F.col("type")).alias("value_type"), kind.alias("aggregate"))


COLUMN_SQL = """'`' || name || '` ' || type || CASE WHEN nullable THEN ' NULL' ELSE ' NOT NULL' END
  || CASE WHEN dflt IS NOT NULL THEN ' DEFAULT "' || dflt || '"' ELSE '' END
  || CASE WHEN comment IS NOT NULL THEN ' COMMENT "' || comment || '"' ELSE '' END"""


@query("render_column_ddl", f"SELECT table_id, ord, {COLUMN_SQL} AS ddl FROM actual_columns")
def render_column_ddl(t):
    fragment = ddl.column_ddl(*map(F.col, ("name", "type", "nullable", "dflt", "comment")))
    return t["actual_columns"].select("table_id", "ord", fragment.alias("ddl"))


@query("render_create_table", f"""
SELECT p.p_partkey AS table_id, 'CREATE TABLE IF NOT EXISTS `db1`.`t' || CAST(p.p_partkey AS STRING) || '` (' || chr(10) || '  ' || b.body || chr(10) || ')' || chr(10)
  || 'ENGINE = OLAP' || chr(10) || CASE WHEN p_partkey % 4 = 0 THEN 'PRIMARY KEY (`id`)' WHEN p_partkey % 4 = 1 THEN 'UNIQUE KEY (`id`)' ELSE 'DUPLICATE KEY (`id`, `ts`)' END
  || chr(10) || 'COMMENT "' || p_name || '"' || chr(10) || CASE WHEN p_partkey % 6 = 0 THEN 'PARTITION BY date_trunc(''day'', `ts`)' || chr(10) ELSE '' END
  || 'DISTRIBUTED BY HASH(`id`) BUCKETS ' || CAST(p_size AS STRING) || chr(10)
  || 'PROPERTIES ("compression" = "LZ4", "replication_num" = "' || CAST(1 + p_partkey % 3 AS STRING) || '")' AS ddl
FROM part p JOIN (SELECT table_id, string_agg({COLUMN_SQL}, ',' || chr(10) || '  ' ORDER BY ord) AS body FROM actual_columns GROUP BY 1) AS b ON b.table_id = p.p_partkey
""")
def render_create_table(t):
    specs = ddl.parse_tables(t["ddl_corpus"], "table_id", "ddl").withColumn("db", F.lit("db1"))
    return ddl.render_create_table(t["actual_columns"], specs, "table_id")


@query("snapshot_removed_columns", """
SELECT table_id, name FROM actual_columns EXCEPT ALL SELECT table_id, name FROM desired_columns
""")
def snapshot_removed_columns(t):
    return t["actual_columns"].select("table_id", "name").exceptAll(t["desired_columns"].select("table_id", "name"))


@query("snapshot_common_columns", """
SELECT table_id, name, upper(type) AS type, nullable, coalesce(dflt, '') AS dflt, coalesce(comment, '') AS comment FROM actual_columns
INTERSECT SELECT table_id, name, upper(type), nullable, coalesce(dflt, ''), coalesce(comment, '') FROM desired_columns
""")
def snapshot_common_columns(t):
    def canonical(columns):
        unset = [F.coalesce(c, F.lit("")).alias(c) for c in ("dflt", "comment")]
        return columns.select("table_id", "name", ddl.normalise_type(F.col("type")).alias("type"), "nullable", *unset)

    return canonical(t["actual_columns"]).intersect(canonical(t["desired_columns"]))


@query("parse_quota", """
SELECT id, quota, CAST(TRY_CAST(regexp_extract(quota, '^(\\d+)[KMGT]$', 1) AS BIGINT) * CASE right(quota, 1)
  WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 END AS BIGINT) AS quota_bytes FROM limit_texts
""".replace("\\\\", "\\"))
def parse_quota(t):
    return t["limit_texts"].select("id", "quota", text.quota_bytes(F.col("quota")).alias("quota_bytes"))


@query("parse_limits", """
SELECT id, TRY_CAST(replace(mem_limit, '%', '') AS DOUBLE) / 100 AS mem_fraction,
  CASE WHEN TRY_CAST(numeric_limit AS BIGINT) > 0 THEN TRY_CAST(numeric_limit AS BIGINT) END AS numeric_limit FROM limit_texts
""")
def parse_limits(t):
    return t["limit_texts"].select(
        "id", text.percent_fraction(F.col("mem_limit")).alias("mem_fraction"), text.positive_limit(F.col("numeric_limit")).alias("numeric_limit")
    )


@query("split_import_ids", """
WITH cut AS (SELECT req_id, import_id, strpos(import_id, '.') AS d1 FROM import_ids),
rest AS (SELECT *, substring(import_id, d1 + 1) AS r, strpos(substring(import_id, d1 + 1), '.') AS d2 FROM cut),
ok AS (SELECT *, d1 > 1 AND r <> '' AS table_ok, d1 > 1 AND d2 > 1 AND substring(r, d2 + 1) <> '' AS index_ok FROM rest)
SELECT req_id, table_ok, CASE WHEN table_ok THEN left(import_id, d1 - 1) END AS table_db, CASE WHEN table_ok THEN r END AS table_name,
  index_ok, CASE WHEN index_ok THEN left(import_id, d1 - 1) END AS index_db, CASE WHEN index_ok THEN left(r, d2 - 1) END AS index_table,
  CASE WHEN index_ok THEN substring(r, d2 + 1) END AS index_name FROM ok
""")
def split_import_ids(t):
    names = ["table_db", "table_name", "table_ok"], ["index_db", "index_table", "index_name", "index_ok"]
    columns = [c.alias(n) for group in names for c, n in zip(text.import_parts(F.col("import_id"), len(group) - 1), group)]
    return t["import_ids"].select("req_id", *columns)


@query("classify_errors", """
SELECT event_id, contains(m, 'unknown database') OR (contains(m, 'database') AND contains(m, 'not exist')) OR contains(m, 'is not found') AS database_missing,
  contains(m, 'unknown table') OR contains(m, 'is not found') OR (contains(m, 'table') AND contains(m, 'doesn''t exist')) OR contains(m, 'does not exist') AS table_missing,
  contains(m, 'does not exist') OR contains(m, 'is not found') OR (contains(m, 'index') AND contains(m, 'not found')) AS index_missing,
  contains(m, 'unknown plugin') OR (contains(m, 'plugin') AND (contains(m, 'not found') OR contains(m, 'does not exist'))) AS plugin_missing,
  contains(m, 'unknown resource group') OR contains(m, 'does not exist') OR contains(m, 'not found') AS group_missing
FROM (SELECT event_id, lower(msg) AS m FROM error_messages) AS e
""")
def classify_errors(t):
    flags = text.not_found_flags(F.col("msg"))
    return t["error_messages"].select("event_id", *(c.alias(n) for n, c in flags.items()))


@query("json_payload", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.tag'), 'none') AS tag FROM events
""")
def json_payload(t):
    parsed = F.from_json(F.coalesce("props", F.lit("{}")), "k bigint, tag string")
    return t["events"].select("event_id", parsed.alias("p")).select("event_id", "p.k", F.coalesce("p.tag", F.lit("none")).alias("tag"))


def property_maps(pairs):
    """One row per table with its recorded and server property maps (a table's few keys)."""
    def side(column):
        entries = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("k", column)))
        return F.map_from_entries(F.array_sort(entries)).alias(column)

    return pairs.groupBy("table_id").agg(side("recorded"), side("server"))


@query("merge_properties", """
WITH tracked AS (SELECT table_id, count(recorded) AS n FROM property_pairs GROUP BY 1)
SELECT p.table_id, p.k, CASE WHEN n = 0 THEN server ELSE coalesce(server, recorded) END AS v
FROM property_pairs p JOIN tracked t ON t.table_id = p.table_id WHERE CASE WHEN n = 0 THEN server IS NOT NULL ELSE recorded IS NOT NULL END
""")
def merge_properties(t):
    merged = text.merge_properties(F.col("recorded"), F.col("server"))
    return property_maps(t["property_pairs"]).select("table_id", F.explode(merged).alias("k", "v"))


@query("prefer_state", """
SELECT table_id, coalesce(nullif(server_engine, ''), old_engine, 'OLAP') AS engine, coalesce(new_key_type, old_key_type, 'DUPLICATE KEY') AS key_type,
  CASE WHEN old_dist <> '' THEN old_dist ELSE server_dist END AS distributed_by, coalesce(nullif(new_comment, ''), old_comment, '') AS comment FROM table_specs
""")
def prefer_state(t):
    col = F.col
    return t["table_specs"].select(
        "table_id",
        text.prefer_server(col("old_engine"), col("server_engine"), "OLAP").alias("engine"),
        text.prefer_server(col("old_key_type"), col("new_key_type"), "DUPLICATE KEY").alias("key_type"),
        text.prefer_recorded(col("old_dist"), col("server_dist")).alias("distributed_by"),
        text.prefer_server(col("old_comment"), col("new_comment"), "").alias("comment"),
    )


@query("strip_index_type", """
SELECT table_id, index_name, column_name, CASE WHEN contains(raw_type, '(') THEN 'NGRAMBF' ELSE raw_type END AS index_type,
  CASE WHEN contains(raw_type, '(') THEN '4' END AS gram_num, CASE WHEN contains(raw_type, '(') THEN '0.05' END AS bloom_filter_fpp FROM index_defs
""")
def strip_index_type(t):
    kind, props = text.strip_index_type(F.col("raw_type"))
    stripped = t["index_defs"].select("table_id", "index_name", "column_name", kind.alias("index_type"), props.alias("props"))
    return stripped.select(
        "table_id", "index_name", "column_name", "index_type",
        F.try_element_at("props", F.lit("gram_num")).alias("gram_num"), F.try_element_at("props", F.lit("bloom_filter_fpp")).alias("bloom_filter_fpp"),
    )


@query("partition_key", """
SELECT query_id, CAST(date_trunc('day', ts_start) AS DATE) AS day_part, CAST(date_trunc('month', ts_start) AS DATE) AS month_part FROM audit
""")
def partition_key(t):
    audit = t["audit"]
    day = text.partition_value("PARTITION BY date_trunc('day', `ts_start`)", audit.columns)
    month = text.partition_value("PARTITION BY date_trunc('month', ts_start)", audit.columns)
    return audit.select("query_id", day.alias("day_part"), month.alias("month_part"))


@query("parse_classifiers", """
SELECT event_id, event_id AS classifier_id, CASE WHEN event_id % 2 = 0 THEN 'u' || CAST(user_id AS STRING) END AS user_name,
  CASE WHEN event_id % 3 = 0 THEN 'analyst' END AS role_name, CASE WHEN event_id % 5 = 0 THEN 'select' END AS query_type,
  CASE WHEN event_id % 7 = 0 THEN '10.0.0.1' END AS source_ip, CASE WHEN event_id % 11 = 0 THEN 'analytics' END AS db FROM events
""")
def parse_classifiers(t):
    fields = text.classifier_fields(F.col("txt"))
    return t["classifier_texts"].select("event_id", *(c.alias(n) for n, c in fields.items()))


ORDER_CHANGES = """
SELECT * FROM VALUES ('MODIFY', 'o_custkey', 'DOUBLE', NULL, 1), ('MODIFY', 'o_totalprice', 'BIGINT', NULL, 2),
  ('MODIFY', 'o_orderpriority', 'VARCHAR(6)', NULL, 3), ('DROP', 'o_orderstatus', NULL, NULL, NULL), ('ADD', 'score', 'BIGINT', '7', 4)
AS c(kind, name, new_type, new_dflt, new_ord)
"""


@query("apply_schema_change", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS o_totalprice, o_orderdate,
  CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority END AS o_orderpriority, CAST(7 AS BIGINT) AS score FROM orders
""")
def apply_schema_change(t):
    return schema.apply_schema_change(t["orders"], schema.typed_changes(t.spark.sql(ORDER_CHANGES)))


@query("schema_change_versions", """
SELECT o_orderkey, o_custkey AS custkey_1, CAST(o_custkey AS DOUBLE) AS custkey_2, o_orderstatus AS status_1, CAST(7 AS BIGINT) AS score_2,
  CASE WHEN length(o_orderpriority) <= 6 THEN o_orderpriority END AS priority_2 FROM orders
""")
def schema_change_versions(t):
    """The orders before and after a staged change, both read from the table's versions."""
    table = workdir(t.spark, "orders")
    before = versions.commit(t["orders"], table)
    after = schema.write_version(table, t.spark, schema.typed_changes(t.spark.sql(ORDER_CHANGES)))
    old, new = versions.read(t.spark, table, before), versions.read(t.spark, table, after)
    old = old.select("o_orderkey", F.col("o_custkey").alias("custkey_1"), F.col("o_orderstatus").alias("status_1"))
    new = new.select("o_orderkey", F.col("o_custkey").alias("custkey_2"), F.col("score").alias("score_2"), F.col("o_orderpriority").alias("priority_2"))
    return old.join(new, "o_orderkey")


@query("schema_change_losses", """
SELECT 'o_custkey' AS column_name, count(o_custkey) AS n_values, CAST(0 AS BIGINT) AS n_lost FROM orders
UNION ALL SELECT 'o_totalprice', count(o_totalprice), 0 FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), count(*) FILTER (WHERE length(o_orderpriority) > 6) FROM orders
""")
def schema_change_losses(t):
    return schema.cast_failures(t["orders"], schema.typed_changes(t.spark.sql(ORDER_CHANGES)))


@query("fill_defaults", "SELECT event_id, user_id, value, '{}' AS props, CAST(1 AS BIGINT) AS weight FROM events")
def fill_defaults(t):
    batch = t["events"].select("event_id", "user_id", "value")
    return schema.fill_defaults(batch, {"value": ("double", "0"), "props": ("string", "{}"), "weight": ("bigint", "1")})


@query("render_properties", """
SELECT table_id, string_agg('"' || k || '" = "' || server || '"', ', ' ORDER BY k) AS props FROM property_pairs WHERE server IS NOT NULL GROUP BY 1
""")
def render_properties(t):
    return property_maps(t["property_pairs"]).select("table_id", ddl.render_properties(F.col("server")).alias("props"))


@query("redact_properties", """
SELECT table_id, k, CASE WHEN k = 'jdbc.password' THEN '******' ELSE recorded END AS v FROM property_pairs WHERE recorded IS NOT NULL
""")
def redact_properties(t):
    masked = text.redact(F.col("recorded"))
    return property_maps(t["property_pairs"]).select("table_id", F.explode(masked).alias("k", "v"))
