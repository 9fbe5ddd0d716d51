"""Reading tables as streams and draining them to a written table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settings

FAR = "2200-01-01 00:00:00"
SETTINGS = {
    # State may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Sessions of a hot key are merged in each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet file or folder as a stream; time columns become TIMESTAMP for watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, name = path.rstrip("/").rsplit("/", 1)
    stream = reader.parquet(f"{folder}/{{{name}}}")  # as a pattern: a plain path must be a folder
    times = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else stream


def _start(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run the stream over all that is there now and append its rows to a parquet folder."""
    with settings(stream.sparkSession, SETTINGS):
        _start(stream.writeStream.format("parquet").outputMode(mode).option("path", out), checkpoint)


def drain_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run the stream over all that is there now, one call per micro-batch."""
    _start(stream.writeStream.foreachBatch(apply).outputMode(mode), checkpoint)


def write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    """Write one micro-batch under its id; a repeat of the batch replaces it."""
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def write_folded(df: DataFrame, table: str, batch_id: int, every: int, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Write one folded micro-batch into the generation of its id.

    A generation takes ``every`` batches. Its first batch also writes what the generation
    before folds to, so that reading the last one is enough and costs no more as batches
    go by. A repeat of a batch replaces all it wrote.
    """
    spark, generation = df.sparkSession, batch_id // every
    if generation and batch_id % every == 0:
        fold(spark.read.parquet(f"{table}/generation={generation - 1}").drop("batch_id")).write.mode("overwrite").parquet(f"{table}/generation={generation}/batch_id=-1")
    write_batch(fold(df), f"{table}/generation={generation}", batch_id)


def read_folded(spark: SparkSession, table: str) -> DataFrame:
    """The batches of the last generation."""
    last = spark.read.parquet(table).agg(F.max("generation")).first()[0]
    return spark.read.parquet(f"{table}/generation={last}").drop("batch_id")


def closing_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """An empty side input of the same columns; `close_with` puts the end marker in it."""
    spark.createDataFrame([], like.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(like.schema).parquet(folder)


def close_with(spark: SparkSession, folder: str, like: DataFrame, at: str, when: str) -> None:
    """One row far in the future, which lifts the watermark past every open window."""
    columns = [F.lit(when).cast(f.dataType).alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    spark.range(1).select(*columns).write.mode("append").parquet(folder)


def in_time_order(df: DataFrame, at: str, n: int) -> list[DataFrame]:
    """The rows cut by time into ``n`` parts of about equal size; rows without a time come first."""
    micros, kind = F.unix_micros(F.col(at).cast("timestamp")), df.schema[at].dataType
    bounds = df.agg(F.percentile_approx(micros, [k / n for k in range(1, n)])).first()[0] or []
    edges = [F.timestamp_micros(F.lit(b)).cast(kind) for b in bounds]
    parts = [df.filter((F.col(at) >= low) & (F.col(at) < high)) for low, high in zip(edges, edges[1:])]
    return [df.filter(F.col(at).isNull() | (F.col(at) < edges[0])), *parts, df.filter(F.col(at) >= edges[-1])] if edges else [df]


def replay(spark: SparkSession, arrivals: list[DataFrame], work: str, at: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream says of rows that arrive one part after another, all of its windows closed.

    Each part is written by all its tasks and drained by a run of its own, from the
    checkpoint of the run before.
    """
    both = None
    with settings(spark, {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for part in arrivals:
            part.write.mode("append").parquet(f"{work}/in")
            if both is None:
                stream = read_stream(spark, f"{work}/in")
                both = stream.unionByName(closing_stream(spark, f"{work}/closing", stream))
            drain(build(both), f"{work}/out", f"{work}/checkpoint")
    close_with(spark, f"{work}/closing", stream, at, FAR)
    drain(build(both), f"{work}/out", f"{work}/checkpoint")
    return spark.read.parquet(f"{work}/out")
