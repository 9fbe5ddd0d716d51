"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: ASCII white space: the bytes \x20 and \x09-\x0D, at which ``bytes.split()`` splits too.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of text that one step of an Arrow loop holds as Python objects.
BLOCK_BYTES = 4 << 20
ROWS_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextmanager
def no_collector():
    """Without the cyclic garbage collector, which would walk all that is held again and again.

    For steps that make many small objects and no cycles.
    """
    running = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if running:
            gc.enable()


def settled(df: DataFrame) -> DataFrame:
    """`cut_lineage`, after which the shuffle files of what led there may go.

    Spark removes them once the driver's collector has found that nothing refers to
    them, which may be long after; asked for it does so now. For steps that shuffle
    more than they write.
    """
    written = cut_lineage(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> list[str]:
    """The columns of ``df`` that an output column would not hide (names compare without case)."""
    hidden = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in hidden]


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under names of our own (c0, c1, ...), and the caller's names for them."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), {name: f"c{k}" for k, name in enumerate(df.columns)}


def restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The caller's columns under the caller's names."""
    return rows.select(*[F.col(own).alias(name) for name, own in names.items()])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`plain` rows with a number each (``rid``), written once.

    The number is fixed by the written table, so a lost executor cannot change it.
    """
    rows, names = plain(df)
    return cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id())), names


def small_batches(df: DataFrame) -> None:
    """Texts are long: what Spark hands to Python at once is ``BATCH_ROWS`` rows, unless the session says otherwise."""
    if df.sparkSession.conf.get(ROWS_SETTING) == "10000":
        df.sparkSession.conf.set(ROWS_SETTING, str(BATCH_ROWS))


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK_BYTES`` of one text column each (one row at least)."""
    start, held = 0, 0
    for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if held and held + (size or 0) > BLOCK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, outputs: T.StructType, start: Callable[[], Callable]) -> DataFrame:
    """``df`` with columns that follow from its text column alone, block by block.

    ``start()`` runs once a task and returns ``fn(texts) -> arrays``, one array for
    each output. An input column of an output's name is replaced.
    """
    kept = without(df, outputs.fieldNames())
    return map_rows(df, [named(c) for c in kept], kept, named(text).cast("string"), outputs, start)


def map_rows(df: DataFrame, columns: list[Column], names: list[str], text: Column, outputs: T.StructType, start: Callable[[], Callable]) -> DataFrame:
    """``columns`` of ``df`` under ``names``, and the outputs made from ``text``."""
    where = len(columns)
    small_batches(df)
    given = df.select(*[c.alias(f"c{i}") for i, c in enumerate([*columns, text])])
    schema = T.StructType(given.schema.fields[:where] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(outputs.fields)])
    kinds = [_arrow(f.dataType) for f in outputs.fields]

    def run(batches):
        fn = start()
        for batch in batches:
            for block in blocks(batch, where):
                with no_collector():
                    made = fn(block.column(where).to_pylist())
                arrays = block.columns[:where] + [pa.array(a, kind) for a, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return given.mapInArrow(run, schema).toDF(*names, *outputs.fieldNames())


def flat_numbers(column: pa.Array, kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(), T.DoubleType: pa.float64()}[type(kind)]
