"""The given tables and the inputs derived from them.

Each derived input is one SELECT that means the same in Spark and in the oracle
engine; every row of its base table takes part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DERIVED: dict[str, str] = {}

DERIVED["audit"] = """
SELECT 'q' || CAST(event_id AS STRING) AS query_id, ts AS ts_start,
  CASE WHEN event_type = 'error' THEN 'connection' WHEN value >= 100 THEN 'slow_query' ELSE 'query' END AS query_type,
  '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS client_ip,
  'u' || CAST(user_id AS STRING) AS user_name,
  CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'analyst' END AS role_name,
  CASE WHEN user_id % 3 = 0 THEN 'analytics' WHEN user_id % 3 = 1 THEN 'app_db' ELSE 'metrics' END AS db,
  CASE WHEN event_type = 'error' THEN 'ERR' WHEN event_type = 'view' THEN 'OK' ELSE 'EOF' END AS state,
  CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id % 7 AS STRING) END AS error_code,
  CAST(floor(value * 10000) AS BIGINT) AS query_time_ms,
  CAST(floor(value * 1000) AS BIGINT) * 64 AS scan_bytes,
  CAST(floor(value * 1000) AS BIGINT) AS scan_rows,
  event_id % 1000 AS return_rows,
  CAST(floor(value * 1000000) AS BIGINT) * 1000 AS cpu_cost_ns,
  CAST(floor(value * 1024) AS BIGINT) * 1024 AS mem_cost_bytes,
  event_id % 500 AS pending_time_ms,
  CAST(floor(value * 900) AS DOUBLE) AS plan_cpu_costs,
  CASE WHEN event_id % 4 = 0 THEN 'mv1,mv2' WHEN event_id % 4 = 1 THEN 'mv1' ELSE '' END AS candidate_mvs,
  CASE WHEN event_id % 8 = 0 THEN 'mv1' ELSE '' END AS hit_mvs,
  'db.t' || CAST(user_id % 9 AS STRING) || ',db.t' || CAST(event_id % 9 AS STRING) AS queried_relations,
  'SELECT c' || CAST(event_id % 5 AS STRING) || ' FROM t' || CAST(user_id % 9 AS STRING) || ' WHERE k = ' || CAST(event_id AS STRING) AS stmt
FROM events
"""

DERIVED["resource_groups"] = """
SELECT * FROM (VALUES
  ('rg_admin',   '80.0%', 20, CAST(1073741824 AS BIGINT), CAST(500000 AS BIGINT), CAST(100 AS BIGINT)),
  ('rg_select',  '40.0%', 11, CAST(104857600 AS BIGINT),  CAST(100000 AS BIGINT), CAST(90 AS BIGINT)),
  ('rg_metrics', '50.0%', 2,  CAST(NULL AS BIGINT),       CAST(50000 AS BIGINT),  CAST(NULL AS BIGINT)),
  ('rg_default', '10.0%', 1,  CAST(NULL AS BIGINT),       CAST(NULL AS BIGINT),   CAST(NULL AS BIGINT))
) AS t(rg_name, mem_limit, concurrency_limit, big_query_mem_limit, big_query_scan_rows_limit, big_query_cpu_second_limit)
"""

DERIVED["classifiers"] = """
SELECT * FROM (VALUES
  (1, 'rg_admin',   CAST(NULL AS STRING), 'admin',              CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)),
  (2, 'rg_select',  CAST(NULL AS STRING), 'analyst',            'query',              CAST(NULL AS STRING), 'analytics'),
  (3, 'rg_metrics', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), 'metrics'),
  (4, 'rg_select',  'u7',                 CAST(NULL AS STRING), 'slow_query',         CAST(NULL AS STRING), CAST(NULL AS STRING)),
  (5, 'rg_metrics', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '10.0.1.1',           CAST(NULL AS STRING)),
  (6, 'rg_admin',   CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING))
) AS t(classifier_id, rg_name, user_name, role_name, query_type, source_ip, db)
"""

DERIVED["ddl_corpus"] = """
SELECT p_partkey AS table_id, 'CREATE TABLE `t' || CAST(p_partkey AS STRING) || '` (' || chr(10)
  || '  `id` bigint(20) NOT NULL COMMENT "pk",' || chr(10)
  || '  `name` varchar(' || CAST(p_size * 8 AS STRING) || ') NULL DEFAULT "' || p_brand || '" COMMENT "' || p_type || '",' || chr(10)
  || CASE WHEN p_partkey % 3 = 0 THEN '  `price` decimal(18, 2) NULL COMMENT "",' || chr(10) ELSE '' END
  || '  `ts` datetime NOT NULL COMMENT ""' || chr(10) || ') ENGINE=OLAP' || chr(10)
  || CASE WHEN p_partkey % 4 = 0 THEN 'PRIMARY KEY(`id`)' WHEN p_partkey % 4 = 1 THEN 'UNIQUE KEY(`id`)' ELSE 'DUPLICATE KEY(`id`, `ts`)' END || chr(10)
  || 'COMMENT "' || p_name || '"' || chr(10)
  || CASE WHEN p_partkey % 6 = 0 THEN 'PARTITION BY date_trunc(''day'', `ts`)' || chr(10) ELSE '' END
  || 'DISTRIBUTED BY HASH(`id`) BUCKETS ' || CAST(p_size AS STRING) || chr(10)
  || 'PROPERTIES ("replication_num" = "' || CAST(1 + p_partkey % 3 AS STRING) || '", "compression" = "LZ4")' AS ddl
FROM part
"""

DERIVED["actual_columns"] = """
SELECT p_partkey AS table_id, 1 AS ord, 'id' AS name, 'BIGINT' AS type, FALSE AS nullable, CAST(NULL AS STRING) AS dflt, 'pk' AS comment FROM part
UNION ALL
SELECT p_partkey, 2, 'name', 'VARCHAR(' || CAST(p_size * 8 AS STRING) || ')', TRUE, p_brand, p_type FROM part
UNION ALL
SELECT p_partkey, 3, 'price', 'DECIMAL(18, 2)', TRUE, CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM (SELECT p_partkey, p_partkey % 3 = 0 AS has_price FROM part) AS p WHERE has_price
UNION ALL
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 3 END, 'ts', 'DATETIME', FALSE, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM part
"""

DERIVED["desired_columns"] = """
SELECT p_partkey AS table_id, 1 AS ord, 'id' AS name, 'bigint' AS type, FALSE AS nullable, CAST(NULL AS STRING) AS dflt, 'pk' AS comment FROM part
UNION ALL
SELECT p_partkey, 2, 'name', 'VARCHAR(' || CAST(p_size * CASE WHEN p_partkey % 5 = 0 THEN 16 ELSE 8 END AS STRING) || ')', TRUE, p_brand,
  CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_type END FROM part
UNION ALL
SELECT p_partkey, 3, 'price', 'DECIMAL(18, 2)', TRUE, CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM (SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 = 1 AS keeps_price FROM part) AS p WHERE keeps_price
UNION ALL
SELECT p_partkey, 4, 'ts', 'DATETIME', FALSE, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM part
UNION ALL
SELECT p_partkey, 5, 'score', 'BIGINT', TRUE, CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM (SELECT p_partkey, p_partkey % 11 = 0 AS adds_score FROM part) AS p WHERE adds_score
"""

DERIVED["index_defs"] = """
SELECT p_partkey AS table_id, 'idx_' || CAST(p_partkey % 4 AS STRING) AS index_name,
  CASE WHEN p_partkey % 13 = 0 THEN 'missing_col' ELSE 'name' END AS column_name,
  CASE WHEN p_partkey % 4 = 0 THEN 'BITMAP' WHEN p_partkey % 4 = 2 THEN 'NGRAMBF("BLOOM_FILTER_FPP" = "0.05", "GRAM_NUM" = "4")' ELSE 'GIN' END AS raw_type
FROM part
UNION ALL
SELECT p_partkey, 'idx_dup', 'name', 'BITMAP' FROM part WHERE p_size > 40
UNION ALL
SELECT p_partkey, 'idx_dup', 'ts', 'BITMAP' FROM part WHERE p_size > 45
UNION ALL
SELECT -1 - p_partkey, 'idx_orphan', 'name', 'VECTOR' FROM part WHERE p_size = 1
"""

DERIVED["alter_jobs"] = """
SELECT o_orderkey AS job_id, o_custkey AS table_id, o_orderdate AS ts,
  CASE WHEN o_orderkey % 17 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'FINISHED' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'PENDING' END AS state,
  o_orderkey % 600 AS elapsed_s
FROM orders
"""

DERIVED["group_listing"] = """
SELECT 'rg' || CAST(user_id % 50 AS STRING) AS rg_name, event_id AS listed,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 2 THEN CAST(event_id % 90 AS STRING) || '%' END AS mem_limit,
  event_id % 4 * (user_id % 5) AS concurrency_limit, CASE WHEN event_id % 5 > 1 THEN (event_id % 7) * 1000 END AS big_query_scan_rows_limit
FROM events
"""

DERIVED["change_feed"] = """
SELECT l_orderkey % 2000 AS part_key, l_orderkey AS seq1, l_linenumber AS seq2, l_partkey AS seq3, l_suppkey AS seq4,
  CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'D' ELSE 'U' END AS op,
  CAST(floor(l_extendedprice) AS BIGINT) AS new_price
FROM lineitem
"""

DERIVED["databases"] = """
SELECT * FROM (VALUES ('analytics', '100M', 4), ('app_db', '10G', 0), ('metrics', '', 102400)) AS t(db, data_quota, replica_quota)
"""

DERIVED["variables"] = """
SELECT 'var_' || CAST(c_custkey AS STRING) AS name,
  CASE WHEN c_custkey % 2 = 0 THEN 'true' WHEN c_custkey % 11 = 0 THEN 'it''s ' || c_mktsegment ELSE CAST(c_custkey * 100 AS STRING) END AS desired,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 2 = 0 THEN '1' WHEN c_custkey % 3 = 0 THEN '0' ELSE CAST(c_custkey * 100 AS STRING) END AS actual
FROM customer
"""

DERIVED["table_specs"] = """
SELECT p_partkey AS table_id, 't' || CAST(p_partkey AS STRING) AS old_name,
  CASE WHEN p_partkey % 50 = 0 THEN 'renamed_' ELSE 't' END || CAST(p_partkey AS STRING) AS new_name,
  'analytics' AS old_database, CASE WHEN p_partkey % 53 = 0 THEN 'metrics' ELSE 'analytics' END AS new_database,
  CASE WHEN p_partkey % 29 = 0 THEN CAST(NULL AS STRING) ELSE 'DUPLICATE KEY' END AS old_key_type,
  CASE WHEN p_partkey % 31 = 0 THEN 'PRIMARY KEY' ELSE 'DUPLICATE KEY' END AS new_key_type,
  'id' AS old_key_columns, CASE WHEN p_partkey % 37 = 0 THEN 'id,ts' ELSE 'id' END AS new_key_columns,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'PARTITION BY date_trunc(''day'', ts)' END AS old_partition,
  CASE WHEN p_partkey % 41 = 0 THEN 'PARTITION BY date_trunc(''month'', ts)' ELSE 'PARTITION BY date_trunc(''day'', ts)' END AS new_partition,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'DISTRIBUTED BY HASH(id) BUCKETS 4' END AS old_dist,
  'DISTRIBUTED BY HASH(`id`) BUCKETS 4' AS server_dist,
  CASE WHEN p_partkey % 9 = 0 THEN 'DISTRIBUTED BY HASH(`id`) BUCKETS 4' WHEN p_partkey % 43 = 0 THEN 'DISTRIBUTED BY HASH(id) BUCKETS 8' ELSE 'DISTRIBUTED BY HASH(id) BUCKETS 4' END AS new_dist,
  'replication_num=3' AS old_properties, CASE WHEN p_partkey % 47 = 0 THEN 'replication_num=1' ELSE 'replication_num=3' END AS new_properties,
  CASE WHEN p_partkey % 17 = 0 THEN 'old comment' ELSE p_name END AS old_comment, p_name AS new_comment,
  CASE WHEN p_partkey % 19 = 0 THEN CAST(NULL AS STRING) ELSE 'MYSQL' END AS old_engine,
  CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'OLAP' END AS server_engine,
  CASE WHEN p_partkey % 59 = 0 THEN 'OLAP' ELSE 'MYSQL' END AS new_engine
FROM part
"""

DERIVED["property_pairs"] = """
SELECT p_partkey AS table_id, 'replication_num' AS k, CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE '3' END AS recorded, CAST(1 + p_partkey % 3 AS STRING) AS server FROM part
UNION ALL
SELECT p_partkey, 'compression', CAST(NULL AS STRING), 'LZ4' FROM part
UNION ALL
SELECT p_partkey, 'jdbc.password', CASE WHEN p_partkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE 's' || CAST(p_partkey AS STRING) END, CAST(NULL AS STRING) FROM part
"""

DERIVED["error_messages"] = """
SELECT event_id, CASE event_id % 9
  WHEN 0 THEN 'Error 1049: Unknown database ''d' || CAST(user_id AS STRING) || '''' WHEN 1 THEN 'database d does not exist'
  WHEN 2 THEN 't1 is not found' WHEN 3 THEN 'some other error' WHEN 4 THEN 'Unknown table ''t'''
  WHEN 5 THEN 'Index i not found' WHEN 6 THEN 'Error 5079: Unknown resource group ''g''' WHEN 7 THEN 'plugin p does not exist'
  ELSE 'Table t doesn''t exist' END AS msg
FROM events
"""

DERIVED["import_ids"] = """
SELECT c_custkey AS req_id, CASE c_custkey % 6 WHEN 0 THEN 'db1.t1' WHEN 1 THEN 'db1.t1.idx1' WHEN 2 THEN 'nodots'
  WHEN 3 THEN '.t1' WHEN 4 THEN 'db1..idx1' ELSE 'db1.t1.idx.v2' END AS import_id
FROM customer
"""

DERIVED["limit_texts"] = """
SELECT p_partkey AS id,
  CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'bad' ELSE CAST(p_size AS STRING) || CASE p_partkey % 6 WHEN 2 THEN 'K' WHEN 3 THEN 'M' WHEN 4 THEN 'G' ELSE 'T' END END AS quota,
  CAST(p_size AS STRING) || '.0%' AS mem_limit,
  CASE p_partkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE CAST(p_partkey AS STRING) END AS numeric_limit
FROM part
"""

DERIVED["classifier_texts"] = """
SELECT event_id, '(id=' || CAST(event_id AS STRING)
  || CASE WHEN event_id % 2 = 0 THEN ', user=u' || CAST(user_id AS STRING) ELSE '' END
  || CASE WHEN event_id % 3 = 0 THEN ', role=analyst' ELSE '' END
  || CASE WHEN event_id % 5 = 0 THEN ', query_type=select' ELSE '' END
  || CASE WHEN event_id % 7 = 0 THEN ', source_ip=10.0.0.1' ELSE '' END
  || CASE WHEN event_id % 11 = 0 THEN ', db=analytics' ELSE '' END || ')' AS txt
FROM events
"""

DERIVED["requested_names"] = """
SELECT c_custkey AS req_id, CASE c_custkey % 4 WHEN 0 THEN 'T' || CAST(c_custkey AS STRING) WHEN 1 THEN 't' || CAST(c_custkey AS STRING)
  WHEN 2 THEN 't_' ELSE 't' || CAST(c_custkey AS STRING) || '_ms' END AS name
FROM customer
"""

DERIVED["batch_types"] = """
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'bigint(20)' WHEN 1 THEN ' int(11) ' WHEN 2 THEN 'tinyint(4)' WHEN 3 THEN 'largeint(40)'
  WHEN 4 THEN 'varchar(' || CAST(p_size AS STRING) || ')' WHEN 5 THEN 'decimal(10, 2)' WHEN 6 THEN 'datetime' ELSE 'bigint(20) sum' END AS raw_type
FROM part
"""

DERIVED["database_specs"] = """
SELECT 'db' || CAST(p_partkey AS STRING) AS db, CASE WHEN p_size > 25 THEN CAST(p_size AS STRING) || 'G' ELSE '' END AS data_quota,
  CASE WHEN p_size % 2 = 0 THEN p_size * 1024 ELSE 0 END AS replica_quota, CASE WHEN p_size % 3 = 0 THEN 'vol_' || p_brand END AS storage_volume
FROM part
"""

DERIVED["group_specs"] = """
SELECT 'rg_' || CAST(c_custkey AS STRING) AS rg_name, CAST(c_nationkey + 1 AS STRING) || '.0%' AS mem_limit,
  CASE WHEN c_acctbal > 0 THEN c_nationkey + 1 END AS concurrency_limit
FROM customer
"""

DERIVED["group_rules"] = """
SELECT 'rg_' || CAST(c_custkey AS STRING) AS rg_name, 2 AS classifier_id, CAST(NULL AS STRING) AS user_name, 'analyst' AS role_name,
  CASE WHEN c_nationkey > 12 THEN 'select' END AS query_type, CASE WHEN c_acctbal > 5000 THEN '10.0.0.1' END AS source_ip, lower(c_mktsegment) AS db
FROM customer
UNION ALL
SELECT 'rg_' || CAST(c_custkey AS STRING), 1, CASE WHEN c_acctbal > 0 THEN 'u' || CAST(c_custkey AS STRING) END, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM customer
"""

# Oracle-only: each query with the group that its best classifier names.
ORACLE_VIEWS = {
    "classified": """
SELECT query_id, rg_name FROM (
  SELECT a.query_id, coalesce(c.rg_name, 'rg_default') AS rg_name,
    row_number() OVER (PARTITION BY a.query_id ORDER BY
      CASE WHEN c.user_name IS NULL THEN 0 ELSE 1 END + CASE WHEN c.role_name IS NULL THEN 0 ELSE 1 END
      + CASE WHEN c.query_type IS NULL THEN 0 ELSE 1 END + CASE WHEN c.source_ip IS NULL THEN 0 ELSE 1 END
      + CASE WHEN c.db IS NULL THEN 0 ELSE 1 END DESC, c.classifier_id) AS rn
  FROM audit a LEFT JOIN classifiers c
    ON coalesce(c.user_name, c.role_name, c.query_type, c.source_ip, c.db) IS NOT NULL
   AND (c.user_name IS NULL OR c.user_name = a.user_name) AND (c.role_name IS NULL OR c.role_name = a.role_name)
   AND (c.query_type IS NULL OR c.query_type = a.query_type) AND (c.source_ip IS NULL OR c.source_ip = a.client_ip)
   AND (c.db IS NULL OR c.db = a.db)) AS m WHERE rn = 1
""",
    "grouped_audit": "SELECT a.*, c.rg_name FROM audit a JOIN classified c USING (query_id)",
    "column_changes": """
SELECT table_id, name, kind, d_ord, a_ord, new_type, new_nullable, new_dflt, new_comment FROM (
  SELECT coalesce(d.table_id, a.table_id) AS table_id, coalesce(d.name, a.name) AS name,
    CASE WHEN a.name IS NULL THEN 'ADD' WHEN d.name IS NULL THEN 'DROP'
      WHEN upper(a.type) <> upper(d.type) OR a.nullable <> d.nullable OR a.dflt IS DISTINCT FROM d.dflt
        OR a.comment IS DISTINCT FROM d.comment THEN 'MODIFY' END AS kind,
    d.ord AS d_ord, a.ord AS a_ord, d.type AS new_type, d.nullable AS new_nullable, d.dflt AS new_dflt, d.comment AS new_comment
  FROM desired_columns d FULL OUTER JOIN actual_columns a ON d.table_id = a.table_id AND d.name = a.name) AS j
WHERE kind IS NOT NULL
""",
    "terms": r"""
SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents
""",
    "chars": "SELECT doc_id, lower(text) AS t, length(lower(text)) AS n FROM documents",
    "grams": """
SELECT DISTINCT doc_id, unnest(CASE WHEN n < 4 THEN [t] ELSE
  list_transform(range(1, n - 2), lambda i: substring(t, i, 4)) END) AS gram FROM chars WHERE n > 0
""",
}


def _mentions(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def placed(sql: str, names: list[str]) -> str:
    """The SQL with the named tables as parameters, so that no view of the caller's session is touched."""
    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(names)})\b", r"\1 {\2}", sql) if names else sql


def inline(sql: str) -> str:
    """Prefix the SQL with a WITH list of the derived inputs it names."""
    every = {**DERIVED, **ORACLE_VIEWS}
    needed: list[str] = []

    def visit(text):
        for name in _mentions(text, every):
            if name not in needed and every[name] is not text:
                visit(every[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({every[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Inputs:
    """``inputs["audit"]`` → DataFrame, for given and derived names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name in DERIVED:
            return self.sql(DERIVED[name])
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """A given table for CPU-heavy work, dealt over all shuffle partitions by its key.

        The number is given, or rows that are few bytes and much work would be put together again.
        """
        return self[name].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    def sql(self, text: str) -> DataFrame:
        names = _mentions(text, BASE)
        return self.spark.sql(placed(text, names), **{n: self[n] for n in names})
