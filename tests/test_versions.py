"""Versions of a table: what counts, what a failed rewrite leaves, repeated batches."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import schema
from millrace.session import workdir
from millrace.sources import versions

CHANGES = [{"kind": "MODIFY", "name": "v", "type": "DOUBLE", "new_dflt": None}, {"kind": "ADD", "name": "w", "type": "BIGINT", "new_dflt": "7"}, {"kind": "DROP", "name": "x"}]


def table_of(spark):
    table = workdir(spark, "t-versions")
    assert versions.commit(spark.range(10).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("x")), table) == 1
    return table


def test_a_change_makes_the_next_version_and_the_old_one_stays(spark):
    table = table_of(spark)
    assert schema.write_version(table, spark, CHANGES) == 2
    new, old = versions.read(spark, table), versions.read(spark, table, 1)
    assert new.dtypes == [("id", "bigint"), ("v", "double"), ("w", "bigint")] and old.dtypes == [("id", "bigint"), ("v", "bigint"), ("x", "string")]
    assert sorted(tuple(r) for r in new.collect()) == [(i, 2.0 * i, 7) for i in range(10)]
    assert [r.version for r in versions.log(spark, table).orderBy("version").collect()] == [1, 2]


def test_a_rewrite_that_fails_is_not_seen(spark, monkeypatch):
    table = table_of(spark)
    dies = F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(versions.read(spark, table).withColumn("v", dies), table)
    assert versions.read(spark, table).count() == 10 and versions.log(spark, table).count() == 1
    # It dies between the data and the log entry.
    with monkeypatch.context() as broken:
        broken.setattr(spark, "createDataFrame", lambda *a: (_ for _ in ()).throw(OSError("gone")), raising=False)
        with pytest.raises(OSError, match="gone"):
            schema.write_version(table, spark, CHANGES)
    assert versions.read(spark, table).columns == ["id", "v", "x"]
    assert schema.write_version(table, spark, CHANGES) == 2
    assert versions.read(spark, table).columns == ["id", "v", "w"]


def test_a_named_batch_is_committed_once(spark):
    table = table_of(spark)
    for _ in range(2):
        assert versions.commit(spark.range(3), table, "batch 5") == 2
    assert versions.commit(spark.range(4), table, "batch 6") == 3
    assert versions.read(spark, table, 2).count() == 3 and versions.read(spark, table).count() == 4
    with pytest.raises(ValueError, match="no version 9"):
        versions.read(spark, table, 9)
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, workdir(spark, "t-none"))
