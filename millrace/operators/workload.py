"""Query-log analytics: workload classification, limits, usage and latency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import digest, quota_bytes
from ..session import cut_lineage
from .ordered import interval_profile

# query-log column → classifier column
CONDITIONS = {
    "user_name": "user_name",
    "role_name": "role_name",
    "query_type": "query_type",
    "client_ip": "source_ip",
    "db": "db",
}


def classify(log: DataFrame, classifiers: DataFrame, default: str = "rg_default") -> DataFrame:
    """Adds ``rg_name``: the group of the best matching classifier.

    All set conditions of a classifier must hold; the one with most conditions wins,
    then the lowest id. A classifier without conditions matches nothing.

    Classifiers that set the same columns form one equi join on those columns, each
    adding at most one match per query. So there are at most 2^5 joins, no nested
    loop, and Spark may broadcast the classifier side by its real size.
    """
    shape = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(q)) for q, c in CONDITIONS.items())))
    shaped = classifiers.withColumn("shape", shape)
    shapes = sorted(r.shape for r in shaped.select("shape").distinct().collect() if r.shape)
    ranked, matches = log, []
    for n, columns in enumerate(shapes):
        keys = [F.col(CONDITIONS[q]).alias(f"m{n}_{q}") for q in columns]
        best = F.min(F.struct("classifier_id", "rg_name")).alias("best")
        rules = shaped.filter(F.col("shape") == F.array(*map(F.lit, columns))).groupBy(*keys).agg(best)
        match = F.struct(F.lit(len(columns)).alias("n"), (-F.col("best.classifier_id")).alias("id"), F.col("best.rg_name").alias("rg"))
        rules = rules.select(*(f"m{n}_{q}" for q in columns), match.alias(f"match{n}"))
        on = reduce(lambda a, b: a & b, [F.col(q) == F.col(f"m{n}_{q}") for q in columns])
        ranked = ranked.join(rules, on, "left").drop(*(f"m{n}_{q}" for q in columns))
        matches.append(F.col(f"match{n}"))
    if not matches:
        return log.withColumn("rg_name", F.lit(default))
    winner = F.array_max(F.array(*matches))["rg"]
    return ranked.withColumn("rg_name", F.coalesce(winner, F.lit(default))).drop(*(f"match{n}" for n in range(len(shapes))))


def fold_group_rows(rows: DataFrame, order: str, key: str = "rg_name") -> DataFrame:
    """One row per group of a listing that has one row per classifier: of each limit the first that is set.

    Empty text and "0" mean unset.
    """
    limits = [c for c in rows.columns if c not in (key, order)]
    set_ = lambda c: F.col(c).isNotNull() & ~F.trim(F.col(c).cast("string")).isin("", "0")
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(set_(c), F.col(order))).alias(c) for c in limits))


def big_query_violations(grouped_log: DataFrame, groups: DataFrame) -> DataFrame:
    """Per day and group: queries, and how many exceed each limit.

    A limit that is null or zero does not limit.
    """
    limits = groups.select(
        "rg_name",
        *(F.nullif(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in groups.columns if c.startswith("big_query_")),
    )

    def over(used, limit):
        return F.count_if(F.coalesce(used > F.col(limit), F.lit(False)))

    return (
        grouped_log.join(limits, "rg_name", "left")
        .groupBy(F.to_date("ts_start").alias("day"), "rg_name")
        .agg(
            F.count(F.lit(1)).alias("n_queries"),
            over(F.col("scan_rows"), "big_query_scan_rows_limit").alias("n_scan_rows"),
            over(F.col("mem_cost_bytes"), "big_query_mem_limit").alias("n_mem"),
            over(F.col("cpu_cost_ns") / 1e9, "big_query_cpu_second_limit").alias("n_cpu"),
        )
    )


def with_end(log: DataFrame) -> DataFrame:
    """Adds ``ts_end`` from the start and the run time."""
    ms = F.make_dt_interval(secs=(F.col("query_time_ms") / 1000).cast("decimal(18,6)"))
    return log.withColumn("ts_end", F.col("ts_start") + ms)


def concurrency_peaks(grouped_log: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group and day the most queries running at once, against the limit.

    Queries still running from the day before count.
    """
    profile = interval_profile(with_end(grouped_log), ["rg_name"], "ts_start", "ts_end")
    after = F.col("run_started") - F.col("run_ended")
    before = after - F.col("started") + F.col("ended")
    peaks = profile.groupBy("rg_name", F.to_date("instant").alias("day")).agg(
        F.max(F.greatest(after, before)).alias("peak"), F.max_by(after, "instant").alias("at_end")
    )
    # Days on which queries run but none starts or ends lie between two of these.
    following = F.lead("day").over(W.partitionBy("rg_name").orderBy("day"))
    between = peaks.withColumn("next_day", following).filter("at_end > 0 AND next_day > date_add(day, 1)")
    idle = between.select("rg_name", F.explode(F.sequence(F.date_add("day", 1), F.date_sub("next_day", 1))).alias("day"), F.col("at_end").alias("peak"))
    peaks = peaks.drop("at_end").unionByName(idle)
    limits = groups.select("rg_name", F.nullif(F.col("concurrency_limit"), F.lit(0)).alias("concurrency_limit"))
    over = F.coalesce(F.col("peak") > F.col("concurrency_limit"), F.lit(False))
    return peaks.join(limits, "rg_name", "left").withColumn("over_limit", over)


def overlap_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Each query with the number of its key's queries that run at the same time.

    Counted from running totals at its two end points: those started before it ends
    less those ended by its start. Pairs are never formed, since one user's pairs
    grow with the square of that user's queries. A query of no duration overlaps
    nothing.
    """
    ended = with_end(log)
    timed = ended.filter("ts_end > ts_start")
    profile = cut_lineage(interval_profile(timed, keys, "ts_start", "ts_end"))  # joined twice
    at_start = profile.select(*keys, F.col("instant").alias("ts_start"), F.col("run_ended").alias("ended"))
    at_end = profile.select(*keys, F.col("instant").alias("ts_end"), F.col("started_before"))
    counted = timed.join(at_start, [*keys, "ts_start"]).join(at_end, [*keys, "ts_end"])
    counted = counted.withColumn("n_overlapping", F.col("started_before") - F.col("ended") - 1).drop("started_before", "ended")
    rest = ended.filter("ts_end > ts_start IS NOT TRUE").withColumn("n_overlapping", F.lit(0).cast("bigint"))
    return counted.unionByName(rest)


def digest_stats(log: DataFrame) -> DataFrame:
    """Per statement fingerprint: count, CPU, slowest and mean time."""
    return log.groupBy(digest(F.col("stmt")).alias("digest")).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("cpu_cost_ns").alias("cpu_ns"),
        F.max("query_time_ms").alias("max_ms"),
        F.avg("query_time_ms").alias("mean_ms"),
    )


def table_replicas() -> Column:
    """Tablet replicas of a parsed table (`ddl.parse_tables`): its buckets times its replication number.

    A table without BUCKETS counts as one bucket, one without the property has three copies,
    the warehouse's default; each partition has as many again, and a definition tells of one.
    """
    buckets = F.regexp_extract("distributed_by", r"(?i)\bBUCKETS\s+(\d+)\b", 1).try_cast("bigint")
    copies = F.col("properties")["replication_num"].try_cast("bigint")
    return F.coalesce(buckets, F.lit(1)) * F.coalesce(copies, F.lit(3))


def quota_report(log: DataFrame, tables: DataFrame, databases: DataFrame) -> DataFrame:
    """Bytes scanned and replicas held (``tables``: db, replicas) per database against its quotas; none means unlimited."""
    used = log.groupBy("db").agg(F.sum("scan_bytes").alias("used_bytes"))
    held = tables.groupBy("db").agg(F.sum("replicas").alias("used_replicas"))
    quotas = databases.select(
        "db",
        quota_bytes(F.col("data_quota")).alias("quota_bytes"),
        F.nullif(F.col("replica_quota"), F.lit(0)).alias("replica_quota"),
    )

    def over(used_column, quota):
        return F.coalesce(F.col(used_column) > F.col(quota), F.lit(False))

    return (
        quotas.join(used, "db", "left").join(held, "db", "left")
        .fillna(0, ["used_bytes", "used_replicas"])
        .withColumn("over_data", over("used_bytes", "quota_bytes"))
        .withColumn("over_replicas", over("used_replicas", "replica_quota"))
    )


def drop_guard(databases: DataFrame, tables: DataFrame) -> DataFrame:
    """Databases that still hold tables: one row per table left, with the count.

    The names stay rows; a database may hold any number of them.
    """
    counts = tables.join(databases.select("db"), "db", "left_semi").groupBy("db").agg(F.count(F.lit(1)).alias("n_tables"))
    return tables.join(counts, "db").select("db", "n_tables", "table_name")


def relation_pairs(log: DataFrame, relations: Column) -> DataFrame:
    """How often two tables are named by one statement, counted before the shuffle."""
    names = F.array_sort(F.array_distinct(relations))
    rest = F.posexplode("names").alias("at", "left_table")
    left = log.select(names.alias("names")).select("names", rest)
    right = F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("right_table")
    return left.select("left_table", right).groupBy("left_table", "right_table").agg(F.count(F.lit(1)).alias("n_queries"))


def relation_popularity(log: DataFrame, relations: Column) -> DataFrame:
    """Per table named: queries, rows scanned, distinct users."""
    used = log.select("query_id", "user_name", "scan_rows", F.explode(F.array_distinct(relations)).alias("relation"))
    return used.groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("scan_rows").alias("scan_rows"),
        F.count_distinct("user_name").alias("n_users"),
    )


def view_hit_ratio(log: DataFrame) -> DataFrame:
    """Per materialized view: times a candidate, times used, ratio."""
    candidates = F.filter(F.split("candidate_mvs", ","), lambda v: v != "")
    hits = F.split("hit_mvs", ",")
    seen = log.select(hits.alias("hits"), F.explode(F.array_distinct(candidates)).alias("mv"))
    return seen.groupBy("mv").agg(
        F.count(F.lit(1)).alias("n_candidate"),
        F.count_if(F.array_contains("hits", F.col("mv"))).alias("n_hit"),
    ).withColumn("hit_ratio", F.col("n_hit") / F.col("n_candidate"))


JOB_OUTCOMES = {"FINISHED": "finished", "CANCELLED": "cancelled"}


def job_outcome(state: Column, elapsed_s: Column, timeout_s: int) -> Column:
    """finished / cancelled / timed_out / running; a timeout of zero or less means 300 s."""
    limit = timeout_s if timeout_s > 0 else 300
    outcome = F.when(elapsed_s >= limit, "timed_out").otherwise("running")
    for name, result in JOB_OUTCOMES.items():
        outcome = F.when(F.upper(state) == name, result).otherwise(outcome)
    return outcome


def job_last_state(jobs: DataFrame) -> DataFrame:
    """The latest job row of each table."""
    last = F.max(F.struct("ts", "job_id", "state")).alias("last")
    return jobs.groupBy("table_id").agg(last).select("table_id", "last.*")
