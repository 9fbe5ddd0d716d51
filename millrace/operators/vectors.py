"""Nearest vectors by cosine: exact, and by short codes of every vector."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut_lineage

QUERY_BLOCK = 256  # queries that travel with a task
TIE_DIGITS = 12  # scores that differ less are ties: sums of products are no more exact
SAMPLED = 8192  # vectors that code books are fitted on, about
WORDS, PART, FIT_ROUNDS = 256, 4, 8  # words of a book, components a word stands for, rounds of fitting
CANDIDATES = 20  # vectors scored exactly for each one asked for


def label_centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(query_id, query): the mean vector of each label."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return vectors.groupBy(F.col(label).alias("query_id")).agg(vector_to_array(mean).alias("query"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(ids: np.ndarray, scores: np.ndarray, query_ids, k: int) -> pd.DataFrame:
    """The k best of one block per query, by score and then id."""
    floor = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k] if len(ids) > k else scores.min(axis=0)
    kept = []
    for j, query_id in enumerate(query_ids):
        able = np.flatnonzero(scores[:, j] >= floor[j])  # all ties of the k-th score
        order = able[np.lexsort((ids[able], -scores[able, j]))[:k]]
        kept.append(pd.DataFrame({"query_id": query_id, "id": ids[order], "score": scores[order, j]}))
    return pd.concat(kept, ignore_index=True)


def _each_task_best(source: DataFrame, queries: DataFrame, k: int, scorer) -> DataFrame:
    """(query_id, id, score): each task's k best of the rows (id, content) per query.

    The queries travel with the tasks, block after block; ``scorer`` makes of a block's
    query matrix a function from a column of contents to scores, rows by queries.
    """
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", source.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def scored(held: list) -> DataFrame:
        query_ids, matrix = [r.query_id for r in held], _unit(_matrix([r.query for r in held]))

        def run(batches):
            best, score = None, scorer(matrix)
            for batch in batches:
                if batch.num_rows:
                    found = _best(batch.column(0).to_numpy(zero_copy_only=False), np.round(score(batch.column(1)), TIE_DIGITS), query_ids, k)
                    best = found if best is None else pd.concat([best, found], ignore_index=True)
                    order = best.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
                    best = order.groupby("query_id", sort=False).head(k)
            if best is not None:
                yield pa.RecordBatch.from_pandas(best, schema=arrow_schema, preserve_index=False)

        return source.mapInArrow(run, schema)

    parts = [scored(held) for held in _blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else source.sparkSession.createDataFrame([], schema)


def _matrix(arrays) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.float64) for a in arrays])


def _arrow_matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list]:
    """The queries in blocks of some ``QUERY_BLOCK`` rows, one at a time on the driver."""
    written = cut_lineage(queries.select("query_id", "query").filter("query IS NOT NULL"))
    parts = -(-written.count() // QUERY_BLOCK)
    for k in range(parts):
        held = written.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == k).collect()
        if held:
            yield held


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """Exact k nearest vectors by cosine of each (query_id, query).

    Every task scores its vectors as one matrix product for each block of queries and
    keeps k per query, so the shuffle carries tasks × queries × k rows.
    """
    source = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    return _ranked(_each_task_best(source, queries, k, lambda matrix: lambda column: _unit(_arrow_matrix(column)) @ matrix.T), k)


def _in_parts(rows: np.ndarray) -> np.ndarray:
    """Rows cut into parts of ``PART`` components, the last one filled up with zeros."""
    padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % PART)))
    return padded.reshape(len(rows), -1, PART)


def _words_of(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest word of a book for each row's part."""
    return (parts @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1).astype(np.uint8)


def code_books(vectors: DataFrame, vector: str, n: int, seed: int = 7) -> np.ndarray | None:
    """For each part of the unit vectors ``WORDS`` words, fitted on about ``SAMPLED`` different vectors chosen by hash."""
    place = F.pmod(F.xxhash64(vector), F.lit(1 << 30)) / (1 << 30)
    chosen = vectors.select(vector).filter(place < min(1.0, SAMPLED / max(n, 1))).distinct().collect()
    if not chosen:
        return None
    rows = _matrix(sorted(r[0] for r in chosen))
    sample, rng, books = _in_parts(_unit(rows)), np.random.default_rng(seed), []
    for p in range(sample.shape[1]):
        parts = sample[:, p]
        book = parts[rng.choice(len(parts), min(WORDS, len(parts)), replace=False)]
        for _ in range(FIT_ROUNDS):
            word = _words_of(parts, book)
            n_of = np.bincount(word, minlength=len(book))
            sums = np.stack([np.bincount(word, parts[:, c], minlength=len(book)) for c in range(PART)], axis=1)
            book = np.where(n_of[:, None] > 0, sums / np.maximum(n_of, 1)[:, None], book)
        books.append(book)
    return np.stack(books)


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, code) of (id, v): one byte for each part of a vector."""
    schema = T.StructType([vectors.schema["id"], T.StructField("code", T.BinaryType())])

    def run(batches):
        for batch in batches:
            codes = b""
            if batch.num_rows:
                parts = _in_parts(_unit(_arrow_matrix(batch.column(1))))
                codes = np.stack([_words_of(parts[:, p], book) for p, book in enumerate(books)], axis=1).tobytes()
            cut = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(books)), batch.num_rows, [None, pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), cut.cast(pa.binary())], schema.fieldNames())

    return vectors.select("id", "v").mapInArrow(run, schema)


def nearest_coded(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, candidates: int = CANDIDATES) -> DataFrame:
    """Approximate k nearest by cosine: short codes of all vectors first, then the exact score of a few.

    A code has a byte for every four components: which of 256 words, fitted on a bounded
    sample, is nearest. All vectors have codes, written once and a fraction of the vectors'
    size. A query's products with all words make a table, and the sum of a code's entries
    estimates the cosine. The best ``candidates`` times k by that, but at most a tenth of all
    vectors (k at least), are scored exactly. A zero vector scores 0; null vectors and
    queries are left out.
    """
    base = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    n = base.count()
    books = code_books(base, "v", n)
    if books is None:
        return nearest(vectors, key, vector, queries, k)  # no vectors
    codes = cut_lineage(coded(base, books))
    asked = cut_lineage(queries.select("query_id", F.col("query").alias("q")).filter("q IS NOT NULL"))

    def scorer(matrix):
        tables = np.einsum("qpc,pwc->pwq", _in_parts(matrix), books)

        def score(column):
            held = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
            return sum(tables[p][held[:, p]] for p in range(len(tables)))

        return score

    tried = max(k, min(candidates * k, n // 10))
    found = _ranked(_each_task_best(codes, asked.withColumnRenamed("q", "query"), tried, scorer), tried).select("query_id", "id")

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q"))
    scored = found.join(base, "id").join(asked, "query_id").select("query_id", "id", F.round(F.when(norm > 0, dot("v", "q") / norm).otherwise(0.0), TIE_DIGITS).alias("score"))
    return _ranked(scored, k)
