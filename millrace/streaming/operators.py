"""Streaming forms of the key models, windows, sessions and job monitoring."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keymodels import aggregate_key, fold_changes, merge_aggregates
from ..operators.workload import JOB_OUTCOMES
from .feeds import FAR, close_with, closing_stream, drain, drain_batches, in_time_order, read_folded, read_stream, replay, write_batch, write_folded


def run_closed(spark: SparkSession, stream: DataFrame, work: str, at: str, build) -> DataFrame:
    """All windows of a bounded replay.

    The watermark stops at the last event, so the last windows stay open. The first
    run takes the data; then one far-future row arrives on a side input and a second
    run on the same checkpoint closes what is left.
    """
    folder = f"{work}/closing"
    both = stream.unionByName(closing_stream(spark, folder, stream))
    drain(build(both), f"{work}/out", f"{work}/checkpoint")
    close_with(spark, folder, stream, at, FAR)
    drain(build(both), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out")


def unique_rows(stream: DataFrame, key: str, at: str, delay: str, salts: int = 8) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark passes them.

    A first pass per (key, salt) leaves at most one row per salt, so the copies of a hot
    key are dropped by several tasks before the pass per key.
    """
    salted = stream.withWatermark(at, delay).withColumn("salt", F.floor(F.rand(1) * salts))
    thinned = salted.dropDuplicatesWithinWatermark([key, "salt"]).drop("salt")
    return thinned.dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, delay: str, length: str, slide: str | None, keys: list[str]) -> DataFrame:
    """Rows per time window and key: tumbling, or sliding when a slide is given."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    counted = stream.withWatermark(at, delay).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n_rows")


def session_counts(stream: DataFrame, at: str, delay: str, gap: str, keys: list[str]) -> DataFrame:
    """Sessions of each key, closed by a pause longer than the gap."""
    span = F.session_window(at, gap)
    counted = stream.withWatermark(at, delay).groupBy(span.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(at).alias("session_end")
    )
    return counted.select(*keys, F.col("w.start").alias("session_start"), "session_end", "n_rows")


def upsert_stream(stream: DataFrame, work: str, keys: list[str], order: list[Column], order_names: list[str], values: list[str], every: int = 100) -> DataFrame:
    """Apply a change feed batch by batch.

    Each batch is folded to its last change per key and written under its id, which a
    restart replaces; the cost of a batch does not depend on the table. After ``every``
    batches they are folded into one.
    """
    spark, table = stream.sparkSession, f"{work}/changes"
    fold = partial(fold_changes, keys=keys, order=order, values=[*order_names, *values])

    def apply(batch, batch_id):
        write_folded(batch, table, batch_id, every, fold)

    drain_batches(stream, apply, f"{work}/checkpoint")
    last = fold_changes(read_folded(spark, table), keys, order, values)
    return last.filter("op = 'U'").drop("op")


def aggregate_stream(stream: DataFrame, work: str, keys: list[str], types: dict[str, str], every: int = 100) -> DataFrame:
    """AGGREGATE KEY table kept up to date: each batch adds its own aggregates; they are merged after ``every`` batches."""
    spark, table = stream.sparkSession, f"{work}/aggregates"

    def apply(batch, batch_id):
        write_folded(batch, table, batch_id, every, lambda df: aggregate_key(df, keys, types))

    drain_batches(stream, apply, f"{work}/checkpoint")
    return merge_aggregates([read_folded(spark, table)], keys, types)


def split_late(stream: DataFrame, work: str, at: str, delay: str) -> None:
    """Tag each row by whether it is older than the earlier batches' latest time less the delay.

    Rows go to ``rows``, each batch's latest time to ``seen``; both are kept by batch
    id, so a repeated batch is compared with the same past.
    """
    spark = stream.sparkSession

    def apply(batch, batch_id):
        latest = None
        if batch_id:  # one value: the latest time of all earlier batches
            latest = spark.read.parquet(f"{work}/seen/batch_id={batch_id - 1}").first()["latest"]
        before = F.lit(latest).cast(batch.schema[at].dataType)
        tagged = batch.withColumn("late", F.coalesce(F.col(at) < before - F.expr(f"INTERVAL {delay}"), F.lit(False)))
        write_batch(tagged, f"{work}/rows", batch_id)
        write_batch(batch.agg(F.greatest(F.max(at), before).alias("latest")), f"{work}/seen", batch_id)

    drain_batches(stream, apply, f"{work}/checkpoint")


def windows_and_late(stream: DataFrame, work: str, at: str, delay: str, build) -> tuple[DataFrame, DataFrame]:
    """The windows over the rows in time, and the rows too late for them or without a time: together all rows.

    Windows drop what arrives behind the watermark; here it is split off and kept first.
    """
    spark = stream.sparkSession
    split_late(stream, f"{work}/split", at, delay)
    rows = spark.read.parquet(f"{work}/split/rows")
    kept = spark.readStream.schema(rows.schema).parquet(f"{work}/split/rows").filter("NOT late").drop("late", "batch_id")
    return run_closed(spark, kept, f"{work}/windows", at, build), rows.filter(F.col("late") | F.col(at).isNull()).drop("late", "batch_id")


#: The latest time of all batches so far, in microseconds.
SEEN = "latest long, batch_id long"


def _job_step(known: DataFrame | None, reports: DataFrame, passed: Column, remember_s: int) -> DataFrame:
    """Jobs known before and reported now: open ones, those decided now (``fresh``) and those remembered."""
    rows = reports.withColumns({"outcome": F.lit(None).cast("string"), "decided_us": F.lit(None).cast("long"), "until_us": F.lit(None).cast("long")})
    if known is not None:
        rows = known.filter(F.coalesce(F.col("until_us") > passed, F.lit(True))).drop("fresh").withColumns(
            {"ended": F.lit(None).cast(reports.schema["ended"].dataType)}
        ).unionByName(rows)
    jobs = rows.groupBy("job_id").agg(F.min("deadline").alias("deadline"), F.min("ended").alias("ended"), *(F.max(c).alias(c) for c in ("outcome", "decided_us", "until_us")))
    in_time = F.col("ended.micros") <= F.col("deadline")
    over = F.col("ended").isNotNull() | F.coalesce(F.col("deadline") <= passed, F.lit(False))
    now = F.when(in_time, F.col("ended.terminal")).when(over, "timed_out")
    decided = F.when(in_time, F.col("ended.micros")).otherwise(F.col("deadline"))
    fresh = F.col("outcome").isNull() & now.isNotNull()
    return jobs.withColumn("fresh", fresh).select(
        "job_id", "deadline", "fresh",
        F.coalesce("outcome", now).alias("outcome"),
        F.when(F.col("fresh"), decided).otherwise(F.col("decided_us")).alias("decided_us"),
        F.when(F.col("fresh"), F.greatest(decided, passed) + remember_s * 1_000_000).otherwise(F.col("until_us")).alias("until_us"),
    )


def monitor_jobs(stream: DataFrame, work: str, at: str, delay: str, limit_s: int, remember_s: int = 7 * 86_400) -> None:
    """Decide each job once: by the first of a terminal report and its time limit.

    A job's limit runs out ``limit_s`` after its start, which each report tells by its time
    and the seconds elapsed; the earliest counts. It has run out once the latest report
    of the earlier batches, less the delay, is past it. Decided jobs are remembered for
    ``remember_s``, so later reports do not decide them again. Reports without an id or a
    time are left out. `job_outcomes` reads what was decided.

    A batch is folded to one row a job, merged with the table of open and remembered jobs
    of the batch before, and written as the next one; two such tables are kept in turn.
    A repeated batch reads the same table and replaces what it wrote.
    """
    spark, limit = stream.sparkSession, limit_s if limit_s > 0 else 300
    id_type = stream.schema["job_id"].dataType.simpleString()
    jobs = f"job_id {id_type}, deadline long, fresh boolean, outcome string, decided_us long, until_us long"

    def apply(batch, batch_id):
        turn, before, known, latest = f"turn={batch_id % 2}", f"turn={(batch_id - 1) % 2}", None, None
        if batch_id:
            known = spark.read.schema(jobs).parquet(f"{work}/jobs/{before}")
            latest = spark.read.schema(SEEN).parquet(f"{work}/seen/{before}").first()["latest"]  # one value
        micros = F.unix_micros(F.col(at).cast("timestamp"))
        left = F.greatest(F.lit(limit) - F.col("elapsed_s"), F.lit(0))
        terminal = F.when(F.upper("state").isin(list(JOB_OUTCOMES)), F.struct(micros.alias("micros"), F.lower("state").alias("terminal")))
        rows = batch.filter(F.col("job_id").isNotNull() & F.col(at).isNotNull())
        reports = rows.groupBy("job_id").agg(F.min(micros + left * 1_000_000).alias("deadline"), F.min(terminal).alias("ended"))
        passed = F.unix_micros(F.timestamp_micros(F.lit(latest).cast("long")) - F.expr(f"INTERVAL {delay}"))
        _job_step(known, reports, passed, remember_s).write.mode("overwrite").parquet(f"{work}/jobs/{turn}")
        fresh = spark.read.schema(jobs).parquet(f"{work}/jobs/{turn}").filter("fresh")
        write_batch(fresh.select("job_id", "outcome", "decided_us"), f"{work}/outcomes", batch_id)
        last = batch.agg(F.greatest(F.max(micros), F.lit(latest).cast("long")).alias("latest"), F.lit(batch_id).cast("long").alias("batch_id"))
        last.write.mode("overwrite").parquet(f"{work}/seen/{turn}")

    drain_batches(stream, apply, f"{work}/checkpoint")


def job_outcomes(spark: SparkSession, work: str, until: str | None = None) -> DataFrame:
    """(job_id, outcome, decided_at) of the jobs decided so far; with ``until``, also those whose limit has run out by then."""
    rows = spark.read.parquet(f"{work}/outcomes").drop("batch_id")
    if until:
        turn = spark.read.parquet(f"{work}/seen").agg(F.max_by("turn", "batch_id")).first()[0]
        left = spark.read.parquet(f"{work}/jobs/turn={turn}").filter(F.col("outcome").isNull() & (F.timestamp_micros("deadline") <= F.lit(until).cast("timestamp")))
        rows = rows.unionByName(left.select("job_id", F.lit("timed_out").alias("outcome"), F.col("deadline").alias("decided_us")))
    return rows.select("job_id", "outcome", F.timestamp_micros("decided_us").alias("decided_at"))


__all__ = [
    "FAR", "aggregate_stream", "drain", "in_time_order", "job_outcomes", "monitor_jobs", "read_stream", "replay", "run_closed", "session_counts",
    "split_late", "unique_rows", "upsert_stream", "windowed_counts", "windows_and_late",
]
