"""Operator 11: clusters of integer vectors, nearest centroids by Walsh-Hadamard progressive search.

A vector of 64 numbers becomes integers, floor(1024 * x), and these their Walsh-Hadamard
coefficients, written once. The transform is exact and keeps distances: sums of squared
differences of coefficients are 64 times those of components. Coefficients are ordered
from few sign changes to many, so the first of them tell most about smooth vectors.

A search reads the coarse block for all centroids, finishes the most promising one and
then adds block after block for the others; a centroid whose sum so far is strictly more
than the finished distance can't be the nearest and goes. Those left at the end have all
64 coefficients and decide, ties by the smaller number.

A round is one pass over the written coefficients. Each task adds up its own vectors, so
a row for each task and cluster is shuffled however large a cluster is, and the driver
holds the centroids only. Sums are exact, so the result depends neither on the order nor
on the number of tasks, and a lost task is simply run again.

Defined cases: a vector that is null, has not 64 components, or has one that is null, not
finite or not between -2**46 and 2**46 (whose sums would leave 64 bits) is left out;
repeated rows count and are returned each; a null id is clustered but starts a centroid
only after all others; equal ids start in the order of their vectors; fewer vectors than
centroids start as many centroids as there are, and the others have no row; an empty
table gives an empty table; of other columns, also those named like an output, none is
returned; distances and sums that do not fit a long are null.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import named

DIM, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Coefficients read at once, coarse to fine.
BLOCKS = (4, 4, 8, 16, 32)
#: Coefficients below this have sums of squared differences within 63 bits; larger ones are Python integers.
NARROW, LIMIT, LONG = 1 << 27, float(1 << 46), 1 << 63
EXACT = T.DecimalType(38, 0)


def _butterfly(x: np.ndarray) -> np.ndarray:
    """Rows times the 64 by 64 matrix of signs, in additions only."""
    n, half = len(x), 1
    while half < DIM:
        pairs = x.reshape(n, DIM // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(n, DIM)
        half *= 2
    return x


SIGNS = _butterfly(np.eye(DIM, dtype=np.int64))
#: The coefficients by the number of sign changes of their row.
COARSE_FIRST = np.argsort((SIGNS[:, 1:] != SIGNS[:, :-1]).sum(axis=1), kind="stable")


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of integer rows, coarse first."""
    return _butterfly(x)[:, COARSE_FIRST]


def restore(y: np.ndarray) -> np.ndarray:
    """The integer rows (or sums of rows) that have these coefficients."""
    natural = np.empty_like(y)
    natural[:, COARSE_FIRST] = y
    return _butterfly(natural) // DIM


def nearest(y: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of coefficients, the nearest centroid's number and the squared distance."""
    if max(np.abs(y).max(initial=0), np.abs(centroids).max(initial=0)) >= NARROW:
        y, centroids = y.astype(object), centroids.astype(object)
    every, read = np.arange(len(y)), BLOCKS[0]
    coarse = y[:, None, :read] - centroids[None, :, :read]
    sums = (coarse * coarse).sum(axis=2)
    lead = sums.argmin(axis=1)
    rest = y[:, read:] - centroids[lead, read:]
    best = sums[every, lead] + (rest * rest).sum(axis=1)
    left = sums <= best[:, None]
    left[every, lead] = False
    rows, numbers = np.nonzero(left)
    so_far = sums[rows, numbers]
    for size in BLOCKS[1:]:
        step = y[rows, read : read + size] - centroids[numbers, read : read + size]
        so_far = so_far + (step * step).sum(axis=1)
        able = so_far <= best[rows]
        rows, numbers, so_far = rows[able], numbers[able], so_far[able]
        read += size
    finished = np.repeat((best + 1)[:, None], len(centroids), axis=1)
    finished[rows, numbers] = so_far
    finished[every, lead] = best
    chosen = finished.argmin(axis=1)
    return chosen, finished[every, chosen] // DIM


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), DIM)


def coefficients(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and coefficients (``coef``) of the vectors that count."""
    scaled = F.transform(named(vector), lambda x: F.floor(x.cast("double") * SCALE))
    able = F.forall(named(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT, F.lit(False)))
    kept = df.filter((F.size(named(vector)) == DIM) & able).select(named(key).alias("key"), scaled.alias("coef"))

    def run(batches):
        for batch in batches:
            y = transform(_matrix(batch.column(1)))
            coef = pa.ListArray.from_arrays(np.arange(0, y.size + 1, DIM, dtype=np.int32), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), coef], ["key", "coef"])

    return kept.mapInArrow(run, kept.schema)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> number of its vectors and sums of their coefficients: ``DIM`` rows a cluster reach the driver."""
    schema = T.StructType().add("cluster", "integer").add("place", "integer").add("n", "long").add("sum", EXACT)
    arrow = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("sum", pa.decimal128(38, 0))])

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIM), object)
        for batch in batches:
            y = _matrix(batch.column(0))
            chosen, _ = nearest(y, centroids)
            if np.abs(y).max(initial=0) >= NARROW:
                y = y.astype(object)
            counts += np.bincount(chosen, minlength=len(centroids))
            for k in np.unique(chosen):
                sums[k] += y[chosen == k].sum(axis=0)
        some = np.flatnonzero(counts)
        columns = [np.repeat(some, DIM), np.tile(np.arange(DIM), len(some)), np.repeat(counts[some], DIM), [Decimal(int(s)) for s in sums[some].ravel()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    parts = rows.select("coef").mapInArrow(run, schema)
    total = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("s")).collect():
        total.setdefault(r.cluster, (r.n, [0] * DIM))[1][r.place] = int(r.s)
    return total


def _moved(components: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """The centroids' components after one round; a centroid without vectors stays."""
    out = components.copy()
    for k, (n, s) in sums.items():
        out[k] = [int(x) // n for x in restore(np.array([s], dtype=object))[0]]
    return out


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "3") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = df.sparkSession
    rows = cut_lineage(coefficients(df, key, vector))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    first = rows.orderBy(order.asc_nulls_last(), "coef").limit(k).collect()
    components = restore(np.array([r.coef for r in first], dtype=np.int64).reshape(len(first), DIM))
    for _ in range(rounds if len(first) else 0):
        components = _moved(components, _sums(rows, transform(components)))
    last = transform(components)
    schema = T.StructType([rows.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            chosen, distance = nearest(_matrix(batch.column(1)), last)
            whole = pa.array([d if d < LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32()), whole], schema.fieldNames())

    if not len(first):
        placed = spark.createDataFrame([], schema)
    else:
        placed = cut_lineage(rows.mapInArrow(run, schema))
    # One row a cluster.
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("sum"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    whole = {r.cluster: int(r.sum) if not r.beyond else LONG for r in sums}
    fits = lambda x: x if x < LONG else None
    digest = {c: hashlib.sha256(",".join(str(int(x)) for x in components[c]).encode()).hexdigest() for c in whole}
    about = [(c, fits(s), fits(sum(whole.values())), digest[c]) for c, s in whole.items()]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
