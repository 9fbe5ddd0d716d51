"""Row semantics of the four key models: duplicate, unique, primary, aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ddl import aggregate_kind, normalise_type
from ..session import cut_lineage

MERGE = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def aggregate_kinds(df: DataFrame, types: dict[str, str]) -> dict[str, str]:
    """Value column → aggregate kind, read from type text such as ``BIGINT SUM``."""
    canonical = [aggregate_kind(normalise_type(F.lit(t))).alias(c) for c, t in types.items()]
    kinds = df.sparkSession.sql("SELECT 1").select(*canonical).first().asDict()
    unknown = [c for c, k in kinds.items() if k not in MERGE]
    if unknown:
        raise ValueError(f"no aggregate kind in the type of {unknown}")
    return kinds


def aggregate_key(df: DataFrame, keys: list[str], types: dict[str, str]) -> DataFrame:
    """AGGREGATE KEY load: value columns folded by key.

    Sums are partial before the shuffle, so a hot key sends one row per task.
    """
    kinds = aggregate_kinds(df, types)
    return df.groupBy(*keys).agg(*(MERGE[k](c).alias(c) for c, k in kinds.items()))


def merge_aggregates(parts: list[DataFrame], keys: list[str], types: dict[str, str]) -> DataFrame:
    """Fold further aggregated batches into an aggregated table, without its detail rows."""
    return aggregate_key(reduce(DataFrame.unionByName, parts), keys, types)


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """UNIQUE KEY read: the latest row of each key; every other column breaks ties.

    The maximum of a struct is combined before the shuffle, unlike a sorted window,
    so copies of one key never meet in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in version]
    newest = F.max(F.struct(*version, *rest)).alias("newest")
    return df.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*df.columns)


def fold_changes(feed: DataFrame, keys: list[str], order: list[Column], values: list[str], op: str = "op") -> DataFrame:
    """The last change of each key; on a full tie a delete wins over an upsert."""
    rank = F.struct(*order, F.when(F.col(op) == "D", 1).otherwise(0))
    last = F.max_by(F.struct(op, *values), rank).alias("last")
    return feed.groupBy(*keys).agg(last).select(*keys, "last.*")


def apply_change_feed(feed: DataFrame, keys: list[str], order: list[Column], values: list[str], op: str = "op") -> DataFrame:
    """PRIMARY KEY state that a feed of upserts and deletes leaves behind."""
    return fold_changes(feed, keys, order, values, op).filter(F.col(op) == "U").drop(op)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], op: str = "op") -> DataFrame:
    """Base rows with one folded batch applied; columns the batch lacks are kept.

    Both joins have the batch on the side Spark may broadcast, so a small batch
    costs no shuffle of the base. A delete of an absent key changes nothing.
    """
    changes = cut_lineage(changes)  # read three times below
    carried = [c for c in changes.columns if c not in keys and c != op]
    renamed = changes.select(*keys, op, *(F.col(c).alias(f"new_{c}") for c in carried))
    kept = base.join(renamed, keys, "left").filter(~F.col(op).eqNullSafe("D"))

    def value(c):
        return F.when(F.col(op).isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in carried else F.col(c)

    updated = kept.select(*(value(c) for c in base.columns))
    known = base.select(*keys).join(changes.select(*keys), keys, "left_semi")
    added = changes.filter(F.col(op) == "U").join(known, keys, "left_anti").drop(op)
    return updated.unionByName(added, allowMissingColumns=True)


def newest_partitions(df: DataFrame, partition: str, n: int) -> DataFrame:
    """Keep the rows of the newest n partitions that hold data.

    Ranks partitions, not rows: the list that is broadcast has at most n rows.
    """
    live = df.select(partition).filter(F.col(partition).isNotNull()).distinct()
    live = live.orderBy(F.col(partition).desc()).limit(n)
    return df.join(F.broadcast(live), partition, "left_semi")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or have a null part, with their row count."""
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    reason = F.when(has_null, "NULL_KEY").when(F.col("n_rows") > 1, "DUPLICATE_KEY")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("reason", reason).filter("reason IS NOT NULL")
