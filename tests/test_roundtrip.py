"""Equalities that hold between operators."""

from compare import spark_rows
from conftest import SF_DIR
from pyspark.sql import functions as F

from millrace.functions import ddl
from millrace.operators import keymodels, schema
from millrace.plans import QUERIES
from millrace.session import workdir
from millrace.sources import layout


def result(spark, key):
    return spark_rows(QUERIES[key](spark, SF_DIR))


def test_rendered_table_parses_back(spark, inputs):
    made = QUERIES["render_create_table"](spark, SF_DIR)
    assert spark_rows(ddl.parse_columns(made, "table_id", "ddl")) == spark_rows(inputs["actual_columns"])


def test_tricky_comment_survives_render_and_parse(spark):
    row = (1, 1, "c", "VARCHAR(8)", True, 'd"f\\t', "x) COMMENT y, (z")
    columns = spark.createDataFrame([row], "table_id long, ord int, name string, type string, nullable boolean, dflt string, comment string")
    specs = spark.createDataFrame(
        [(1, "db", "t", "OLAP", None, None, 'say "hi"', None, "DISTRIBUTED BY RANDOM", {"k": 'a"b'})],
        "table_id long, db string, name string, engine string, key_type string, key_columns array<string>, comment string,"
        "partition_by string, distributed_by string, properties map<string,string>",
    )
    made = ddl.render_create_table(columns, specs, "table_id")
    assert spark_rows(ddl.parse_columns(made, "table_id", "ddl")) == spark_rows(columns)
    parsed = ddl.parse_tables(made, "table_id", "ddl").first()
    assert (parsed.comment, parsed.properties, parsed.distributed_by) == ('say "hi"', {"k": 'a"b'}, "DISTRIBUTED BY RANDOM")


def test_applied_changes_leave_no_difference(spark, inputs):
    desired, actual = inputs["desired_columns"], inputs["actual_columns"]
    diff = schema.column_diff(desired, actual)
    kept = actual.join(diff.filter("kind <> 'ADD'").select("table_id", "name"), ["table_id", "name"], "left_anti")
    written = diff.filter("kind <> 'DROP'").select(
        "table_id", F.col("new_ord").alias("ord"), "name", F.col("new_type").alias("type"),
        F.col("new_nullable").alias("nullable"), F.col("new_dflt").alias("dflt"), F.col("new_comment").alias("comment"),
    )
    assert schema.column_diff(desired, kept.unionByName(written)).count() == 0


def test_same_answers_by_two_ways(spark):
    for one, other in [
        ("ngram_candidates", "substring_search"), ("aggregate_key_merge", "aggregate_key_rollup"),
        ("stream_upsert", "change_feed_apply"), ("stream_aggregate_key", "aggregate_key_rollup"),
    ]:
        assert result(spark, one) == result(spark, other), (one, other)


def test_bloom_filter_changes_no_rows(spark, inputs):
    plain = inputs["events"].filter(F.col("props") == '{"k": 69}').select("event_id", "user_id", "event_type", "value")
    assert result(spark, "bloom_skipping") == spark_rows(plain)


def test_even_layout_is_even(spark, inputs):
    path = workdir(spark, "even")
    layout.write_even(inputs["events"], path, 4)
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 4


def test_sorted_layout_has_disjoint_sorted_files(spark, inputs):
    path = workdir(spark, "sorted")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # else so few rows make one file
    try:
        layout.write_sorted(inputs["lineitem"], path, ["l_orderkey", "l_linenumber"])
    finally:
        spark.conf.unset(coalesce)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in files.collect())
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_upsert_rules(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k long, name string, v double")
    feed = spark.createDataFrame([(1, 1, "U", 9.0), (1, 2, "U", 8.0), (2, 1, "U", 7.0), (2, 2, "D", None), (5, 1, "D", 1.0), (6, 1, "U", None)], "k long, seq long, op string, v double")
    folded = keymodels.fold_changes(feed, ["k"], [F.col("seq")], ["v"])
    rows = sorted(tuple(r) for r in keymodels.upsert(base, folded, ["k"]).collect())
    assert rows == [(1, "a", 8.0), (3, "c", 3.0), (6, None, None)]


def test_null_keys_are_violations(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (3, 3)], "a int, b int")
    rows = {(r.a, r.b, r.n_rows, r.reason) for r in keymodels.key_violations(df, ["a", "b"]).collect()}
    assert rows == {(1, 1, 2, "DUPLICATE_KEY"), (None, 2, 1, "NULL_KEY")}


def test_defaults_fill_absent_columns_only(spark):
    batch = spark.createDataFrame([(1, None)], "id int, props string")
    assert schema.fill_defaults(batch, {"props": ("string", "{}"), "n": ("bigint", "0")}).first().asDict() == {"id": 1, "props": None, "n": 0}


def test_column_changes_reach_the_data(spark):
    """Add a column, change its type, drop it; then the diff is empty each time."""
    spec = "table_id int, ord int, name string, type string, nullable boolean, dflt string, comment string"
    columns = [(1, 1, "id", "BIGINT", False, None, None), (1, 2, "payload", "VARCHAR(1024)", True, None, None)]
    steps = [
        columns + [(1, 3, "score", "bigint(20)", True, "7", None)],
        columns + [(1, 3, "score", "DOUBLE", True, "7", None)],
        [columns[0], (1, 2, "payload", "INT", True, None, None)],
    ]
    data, now = spark.createDataFrame([(1, "12"), (2, "x")], "id long, payload string"), columns
    seen = []
    for step in steps:
        diff = schema.column_diff(spark.createDataFrame(step, spec), spark.createDataFrame(now, spec))
        changes = schema.typed_changes(diff)
        data, now = schema.apply_schema_change(data, changes), step
        seen.append((data.dtypes, [tuple(r) for r in data.orderBy("id").collect()]))
    assert seen == [
        ([("id", "bigint"), ("payload", "string"), ("score", "bigint")], [(1, "12", 7), (2, "x", 7)]),
        ([("id", "bigint"), ("payload", "string"), ("score", "double")], [(1, "12", 7.0), (2, "x", 7.0)]),
        ([("id", "bigint"), ("payload", "int")], [(1, 12), (2, None)]),
    ]
