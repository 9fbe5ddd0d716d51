"""Scalar rules, case by case."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions import ddl, quoting, text
from millrace.functions.casts import cast_or_null
from millrace.operators import quality, schema, workload
from millrace.session import workdir


def one(spark, value, *exprs):
    row = spark.createDataFrame([(value,)], "s string").select(*exprs).first()
    return row[0] if len(row) == 1 else tuple(row)


@pytest.mark.parametrize("raw, want", [
    ("bigint(20)", "BIGINT"), ("int(11)", "INT"), ("tinyint(4)", "TINYINT"), ("smallint(6)", "SMALLINT"),
    ("largeint(40)", "LARGEINT"), ("varchar(128)", "VARCHAR(128)"), ("decimal(10, 2)", "DECIMAL(10, 2)"),
    ("BIGINT", "BIGINT"), ("datetime", "DATETIME"), (" int(11)\n", "INT"), ("bigint(20) sum", "BIGINT SUM"),
    ("bigint(20)x", "BIGINT(20)X"),
])
def test_normalise_type(spark, raw, want):
    assert one(spark, raw, ddl.normalise_type(F.col("s"))) == want


@pytest.mark.parametrize("line, want", [
    ('  `id` int(11) NOT NULL COMMENT "",', ("id", "INT", False, None, None)),
    ('  `name` varchar(128) NULL DEFAULT "anon" COMMENT "user name",', ("name", "VARCHAR(128)", True, "anon", "user name")),
    ("  `score` bigint(20) NOT NULL", ("score", "BIGINT", False, None, None)),
    ('`note` string COMMENT "a (b, c) \\"d\\" NOT NULL",', ("note", "STRING", True, None, 'a (b, c) "d" NOT NULL')),
    ('`n` decimal(10, 2) NULL DEFAULT "0.00"', ("n", "DECIMAL(10, 2)", True, "0.00", None)),
    ("`pv` bigint(20) SUM NULL", ("pv", "BIGINT SUM", True, None, None)),
    ("", None), ("  INDEX idx_name (`name`) USING BITMAP", None), ("  PRIMARY KEY (`id`)", None), ("`x` NOT NULL", None),
])
def test_column_line(spark, line, want):
    corpus = spark.createDataFrame([(1, f"CREATE TABLE `t` (\n{line}\n) ENGINE=OLAP")], "table_id long, ddl string")
    rows = [tuple(r)[2:] for r in ddl.parse_columns(corpus, "table_id", "ddl").collect()]
    assert rows == ([want] if want else [])


TABLE = """CREATE TABLE `events` (
  `id` bigint(20) NOT NULL COMMENT "a) PARTITION BY x",
  `ts` datetime NOT NULL
) ENGINE=OLAP
DUPLICATE KEY(`id`, `ts`)
COMMENT "raw (all) \\"events\\""
PARTITION BY date_trunc('day', `ts`)
DISTRIBUTED BY HASH(`id`) BUCKETS 4
PROPERTIES (
"replication_num" = "3",
"note" = "f(x)"
);"""


def test_table_clauses(spark):
    corpus = spark.createDataFrame([(1, TABLE)], "table_id long, ddl string")
    row = ddl.parse_tables(corpus, "table_id", "ddl").first()
    assert (row.name, row.engine, row.key_type, row.key_columns) == ("events", "OLAP", "DUPLICATE KEY", ["id", "ts"])
    assert row.partition_by == "PARTITION BY date_trunc('day', `ts`)"
    assert row.distributed_by == "DISTRIBUTED BY HASH(`id`) BUCKETS 4"
    assert row.comment == 'raw (all) "events"'
    assert row.properties == {"replication_num": "3", "note": "f(x)"}


def test_table_without_optional_clauses(spark):
    corpus = spark.createDataFrame([(1, "CREATE TABLE `u` (\n  `a` int NULL\n) ENGINE=OLAP\nPRIMARY KEY(`a`)")], "table_id long, ddl string")
    row = ddl.parse_tables(corpus, "table_id", "ddl").first()
    assert (row.partition_by, row.distributed_by, row.comment, row.properties) == (None, None, None, {})


@pytest.mark.parametrize("quota, want", [
    ("10G", 10 * 1024**3), ("500M", 500 * 1024**2), ("2T", 2 * 1024**4), ("7k", 7 * 1024), ("12", 12), ("1 GB", 1024**3),
    ("", None), ("0", None), ("bad", None), ("-1G", None),
])
def test_quota(spark, quota, want):
    assert one(spark, quota, text.quota_bytes(F.col("s"))) == want


@pytest.mark.parametrize("limit, want", [("11", 11), ("0", None), ("", None), ("x", None), ("-3", None), ("99999999999999999999", None)])
def test_limit(spark, limit, want):
    assert one(spark, limit, text.positive_limit(F.col("s"))) == want


def test_percent(spark):
    assert one(spark, "80.0%", text.percent_fraction(F.col("s"))) == 0.8
    assert one(spark, "80", text.percent_fraction(F.col("s"))) is None


@pytest.mark.parametrize("import_id, n, want", [
    ("db.t", 2, ("db", "t", True)), ("db.t.x", 2, ("db", "t.x", True)), ("db", 2, (None, None, False)), (".t", 2, (None, None, False)),
    ("db.t.i", 3, ("db", "t", "i", True)), ("db.t.i.v2", 3, ("db", "t", "i.v2", True)), ("db..i", 3, (None, None, None, False)),
    ("db.t.", 3, (None, None, None, False)),
])
def test_import_id(spark, import_id, n, want):
    assert one(spark, import_id, *text.import_parts(F.col("s"), n)) == want


@pytest.mark.parametrize("message, want", [
    ("Error 1049: Unknown database 'mydb'", True), ("database mydb does not exist", True), ("mydb is not found", True),
    ("some other error", False), ("table t does not exist", False),
])
def test_database_missing(spark, message, want):
    assert one(spark, message, text.not_found_flags(F.col("s"))["database_missing"]) is want


@pytest.mark.parametrize("raw, want", [
    ("id=1, user=alice", (1, "alice", None, None, None, None)),
    ("id=42", (42, None, None, None, None, None)),
    ("(id=3, role=r, query_type=select, source_ip=10.0.0.1, db=d)", (3, None, "r", "select", "10.0.0.1", "d")),
])
def test_classifier_text(spark, raw, want):
    assert one(spark, raw, *text.classifier_fields(F.col("s")).values()) == want


def test_digest_keeps_digits_in_names(spark):
    assert one(spark, "SELECT  c1 FROM t2\nWHERE k = 17 AND v = 'it''s 5'", text.normal_statement(F.col("s"))) == "SELECT c1 FROM t2 WHERE k = ? AND v = ?"


@pytest.mark.parametrize("tricky", ['back\\slash "quote"', 'line\nbreak\ttab', '\\n is no line end', '"', "\\", '\\"', 'ends in \\\\', "a\r\n\x07b", ""])
def test_quoting_round_trip(spark, tricky):
    quoted = one(spark, tricky, quoting.quote(F.col("s")))
    assert "\n" not in quoted
    back = quoting.unquote(F.regexp_extract(quoting.hide_escapes(F.col("s")), quoting.QUOTED, 1))
    assert one(spark, f"x = {quoted}, y", back) == tricky


@pytest.mark.parametrize("literal", ["x" * (1 << 20), "''" * (1 << 19), "\\" * (1 << 19)])
def test_long_literals(spark, literal):
    assert one(spark, f"INSERT INTO t VALUES ('{literal}', 7)", text.normal_statement(F.col("s"))) == "INSERT INTO t VALUES (?, ?)"


@pytest.mark.parametrize("comment", ["x" * (1 << 20), '\\"' * (1 << 19), "\\\\" * (1 << 18), "(" * 1000 + "," * 1000])
def test_long_comments(spark, comment):
    made = f'CREATE TABLE `t` (\n  `c` int NULL COMMENT "{comment}"\n) ENGINE=OLAP\nCOMMENT "{comment}"\nPROPERTIES ("k" = "{comment}")'
    df = spark.createDataFrame([(1, made)], "id int, ddl string")
    want = comment.replace('\\"', '"').replace("\\\\", "\\")
    column, table = ddl.parse_columns(df, "id", "ddl").first(), ddl.parse_tables(df, "id", "ddl").first()
    assert (column.type, column.comment, table.engine, table.comment, table.properties) == ("INT", want, "OLAP", want, {"k": want})


def test_ddl_on_one_line(spark):
    made = ('CREATE TABLE `t` (`id` bigint(20) NOT NULL COMMENT "a, `b` (c", `v` decimal(18, 2) NULL DEFAULT "0", `n` varchar(8) NULL) ENGINE=OLAP '
            'PRIMARY KEY(`id`, `v`) COMMENT "PARTITION BY no" PARTITION BY date_trunc(\'day\', `ts`) DISTRIBUTED BY HASH(`id`) BUCKETS 3 PROPERTIES ("a" = "1", "b" = "2", "a" = "3")')
    df = spark.createDataFrame([(1, made)], "id int, ddl string")
    assert [(r.ord, r.name, r.type, r.nullable, r.dflt, r.comment) for r in ddl.parse_columns(df, "id", "ddl").collect()] == [
        (1, "id", "BIGINT", False, None, "a, `b` (c"), (2, "v", "DECIMAL(18, 2)", True, "0", None), (3, "n", "VARCHAR(8)", True, None, None),
    ]
    r = ddl.parse_tables(df, "id", "ddl").first()
    assert (r.name, r.engine, r.key_type, r.key_columns, r.comment) == ("t", "OLAP", "PRIMARY KEY", ["id", "v"], "PARTITION BY no")
    assert (r.partition_by, r.distributed_by, r.properties) == ("PARTITION BY date_trunc('day', `ts`)", "DISTRIBUTED BY HASH(`id`) BUCKETS 3", {"a": "3", "b": "2"})


def test_line_break_in_a_comment(spark):
    made = 'CREATE TABLE `t` (\n  `c` int NULL COMMENT "one\ntwo",\n  `d` int NOT NULL COMMENT "three\\nfour"\n) ENGINE=OLAP'
    df = spark.createDataFrame([(1, made)], "id int, ddl string")
    assert [(r.type, r.comment) for r in ddl.parse_columns(df, "id", "ddl").collect()] == [("INT", "one\ntwo"), ("INT", "three\nfour")]


def test_repeated_index_property(spark):
    kind, props = text.strip_index_type(F.col("s"))
    assert one(spark, 'ngrambf("GRAM_NUM" = "4", "gram_num" = "5")', kind, props) == ("NGRAMBF", {"gram_num": "5"})


def test_text_lengths_are_kept(spark):
    df = spark.createDataFrame([("abcdefgh", ["abc", "d"]), ("abc", ["abcd"]), (None, None)], "c string, a array<string>")
    changes = [{"kind": "MODIFY", "name": "c", "type": "VARCHAR(3)", "new_dflt": None}, {"kind": "MODIFY", "name": "a", "type": "ARRAY<VARCHAR(3)>", "new_dflt": None}]
    assert [tuple(r) for r in schema.apply_schema_change(df, changes).collect()] == [(None, ["abc", "d"]), ("abc", None), (None, None)]
    assert {(r.column_name, r.n_values, r.n_lost) for r in schema.cast_failures(df, changes).collect()} == {("c", 2, 1), ("a", 2, 1)}
    assert schema.cast_failures(df, []).count() == 0
    assert quality.constraint_violations(df, [("c", "DOUBLE", True)]).count() == 1 and quality.constraint_violations(df, [("c", "VARCHAR", True)]).count() == 0


def test_properties(spark):
    df = spark.createDataFrame(
        [({"a": "1", "gone": "x"}, {"a": "2", "extra": "3"}), ({}, {"b": "1"}), (None, {"c": "1"})],
        "recorded map<string,string>, server map<string,string>",
    )
    merged = [r[0] for r in df.select(text.merge_properties(F.col("recorded"), F.col("server"))).collect()]
    assert merged == [{"a": "2", "gone": "x"}, {"b": "1"}, {"c": "1"}]
    masked = df.limit(1).select(text.redact(F.create_map(F.lit("aws.s3.access_key"), F.lit("k"), F.lit("uri"), F.lit("u")))).first()[0]
    assert masked == {"aws.s3.access_key": "******", "uri": "u"}


@pytest.mark.parametrize("value, target, want", [
    ("12", "int", 12), (" +12\n", "int", 12), ("1.5", "int", None), ("5-LOW", "int", None), ("300", "tinyint", None),
    ("1e3", "double", 1000.0), ("Infinity", "double", float("inf")), ("abc", "double", None), ("12.345", "decimal(4,2)", None),
    ("true", "boolean", True), ("maybe", "boolean", None), (None, "int", None),
])
def test_cast_or_null(spark, value, target, want):
    got = one(spark, value, cast_or_null(F.col("s"), StringType(), target))
    plain = one(spark, value, F.col("s").try_cast(target))
    assert got == plain
    if target != "decimal(4,2)":
        assert got == want


def wide_ddl(n):
    """A table of ``n`` columns and ``n`` properties, two keys of which are repeated."""
    columns = ",\n".join(f'  `c{i}` varchar(20) NOT NULL COMMENT "c (x) {i}"' for i in range(n))
    props = ", ".join(f'"k{i % (n - 2)}" = "v{i}"' for i in range(n))
    return f"CREATE TABLE `t` (\n{columns}\n) ENGINE=OLAP\nDUPLICATE KEY(`c0`)\nDISTRIBUTED BY HASH(`c0`) BUCKETS 4\nPROPERTIES ({props})"


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_parsing_costs_grow_with_the_text(spark, n):
    """5,000 columns and properties a table: a step per pair of entries would take hours here."""
    df = spark.createDataFrame([(k, wide_ddl(n)) for k in range(4)], "id long, ddl string")
    began = time.perf_counter()
    tables = ddl.parse_tables(df, "id", "ddl").collect()
    columns = ddl.parse_columns(df, "id", "ddl").collect()
    kind, props = text.strip_index_type(F.concat(F.lit("NGRAMBF"), F.regexp_extract("ddl", r"(?s)PROPERTIES (\(.*\))", 1)))
    stripped = df.select(kind.alias("kind"), props.alias("props")).collect()
    assert time.perf_counter() - began < 30
    assert all(len(r.properties) == n - 2 and r.properties["k0"] == f"v{n - 2}" and r.properties["k1"] == f"v{n - 1}" and r.properties["k2"] == "v2" for r in tables)
    assert len(columns) == 4 * n and {r.comment for r in columns if r.ord == n} == {f"c (x) {n - 1}"}
    assert all(r.kind == "NGRAMBF" and r.props == {k.lower(): v for k, v in tables[0].properties.items()} for r in stripped)


def test_column_sketch_reads_the_schema_in_one_pass(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 5000).alias("few`. 0"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("text"),
        F.lit(None).cast("double").alias("none"), F.array("id").alias("list"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 100).cast("int")).alias("day"),
    )
    sketch = quality.column_sketch(df)
    rows = {r.column_name: r for r in sketch.collect()}
    assert list(rows) == ["few`. 0", "text", "none", "day"]
    assert [(r.n_rows, r.n_null) for r in rows.values()] == [(20_000, 0), (20_000, 5000), (20_000, 20_000), (20_000, 0)]
    for name, exact in {"few`. 0": 5000, "text": 15_000, "none": 0, "day": 100}.items():
        assert abs(rows[name].n_distinct - exact) <= 4 * 0.02 * exact
    assert rows["few`. 0"].quartiles == pytest.approx([1250, 2500, 3750], abs=4) and rows["day"].quartiles is None
    assert (rows["text"].max_length, rows["none"].max_value, rows["day"].max_value) == (5, None, "2024-04-09")
    assert sketch.columns == quality.column_sketch(df.select("list")).columns and quality.column_sketch(df.select("list")).count() == 0
    assert quality.column_sketch(df.limit(0)).filter("n_rows = 0 AND n_distinct = 0 AND min_value IS NULL").count() == 4
    executed = sketch._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in executed and "hashpartitioning" not in executed


def test_replicas_of_parsed_tables(spark):
    tail = ["DISTRIBUTED BY HASH(`a`) BUCKETS 12\nPROPERTIES (\"replication_num\" = \"2\")", "DISTRIBUTED BY RANDOM", "DISTRIBUTED BY HASH(`a`) BUCKETS 5\nPROPERTIES (\"replication_num\" = \"x\", \"k\" = \"BUCKETS 9\")", ""]
    corpus = spark.createDataFrame([(i, f"CREATE TABLE `t{i}` (\n  `a` int NULL\n) ENGINE=OLAP\n{t}") for i, t in enumerate(tail)], "table_id int, ddl string")
    tables = ddl.parse_tables(corpus, "table_id", "ddl").select("table_id", workload.table_replicas().alias("replicas"))
    assert {r.table_id: r.replicas for r in tables.collect()} == {0: 24, 1: 3, 2: 15, 3: 3}
    log = spark.createDataFrame([("a", 60), ("a", 60), ("b", 1)], "db string, scan_bytes long")
    databases = spark.createDataFrame([("a", "100", 40), ("b", "", 0), ("c", "1K", 1)], "db string, data_quota string, replica_quota int")
    report = workload.quota_report(log, tables.select(F.lit("a").alias("db"), "replicas"), databases)
    assert {r.db: (r.used_bytes, r.used_replicas, r.over_data, r.over_replicas) for r in report.collect()} == {"a": (120, 45, True, True), "b": (1, 0, False, False), "c": (0, 0, False, False)}
