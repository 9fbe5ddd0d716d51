"""Operator 12: ranked lexical search by NRA, reading impact-sorted postings in order.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased.
The postings of the query terms are written once with the documents' lengths; corpus
counts (documents, terms, documents of each term) are added up from them by Spark. A
posting's impact is (10**9 * tf) div (1000 * tf + 8 * m), where m grows with the document's
length; a document's score sums weight times impact over an item's terms.

The postings are kept by document, so a frequent term is spread over all tasks. A task
sorts the postings of a block of documents by term and impact and answers every item from
them without random access: it reads each of the item's lists from its greatest impact
down, a batch at a time. What has been read of a document is its lower score; its upper
score adds, for each list in which it has not been met, the greatest score still unread.
Documents whose upper score is below the k-th lower score (or the k-th score of the
blocks before) are out, and what the lists still hold of them is passed over. Reading goes
on until the upper and lower scores of all documents left agree, so members, ties and
scores are final. Each task returns k rows an item at most, of which Spark ranks the best.

Items travel with the tasks in groups of at most some ``GROUP_TERMS`` terms, one pass over
the documents for each group. A block has so few documents that documents times an item's
lists stay below ``CELLS``.

Defined cases: a null, empty or separator-only text has no terms, counts in no statistic
and is never found; an item without terms, or whose terms no document has, has no rows;
every row of the items is ranked by itself, repeated and null ids included; repeated
documents are ranked each, null document ids after all others of their score; empty tables
give an empty table; other columns, also those named like an output, are not read.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .common import annotate, flat_numbers, named

#: Bytes to bytes: A-Z lower-cased, all that separates terms a blank.
FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
#: Terms of items that go to the tasks at once; documents and cells (documents times lists) of a block; first read of a list.
GROUP_TERMS, BLOCK_DOCS, CELLS, STEP = 1 << 20, 1 << 14, 1 << 24, 64
#: Impacts are below 10**6: a term and an impact make one sort key.
IMPACT_BITS = 20


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, order: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a block and their scores, none below ``floor``.

    ``lists`` hold documents and scores, greatest first; ``order`` breaks ties.
    """
    lower, seen = np.zeros(n_docs, np.int64), np.zeros((len(lists), n_docs), bool)
    step = STEP
    while True:
        unread = []
        for t, (docs, scores) in enumerate(lists):
            now = docs[:step]
            lower[now] += scores[:step]
            seen[t, now] = True
            unread.append((docs[step:], scores[step:]))
        lists, step = unread, 2 * step
        front = np.array([scores[0] if len(scores) else 0 for _, scores in lists], np.int64)
        upper = lower + front.sum() - front @ seen
        bar = max(floor, 1)
        if n_docs > k:
            bar = max(bar, int(np.partition(lower, n_docs - k)[n_docs - k]))
        able = upper >= bar
        left = np.flatnonzero(able)
        if (upper[left] == lower[left]).all():
            chosen = left[np.lexsort((order[left], -lower[left]))[:k]]
            return chosen, lower[chosen]
        # Reading on, what belongs to documents that are out is passed over.
        lists = [(docs[keep], scores[keep]) for docs, scores in lists for keep in [able[docs]]]


def _postings(docs: DataFrame, key: str, text: str, numbers: dict[bytes, int]) -> DataFrame:
    """key, n_terms, and numbers and counts of the terms that items ask for, as 32-bit integers."""
    outputs = T.StructType().add("n_terms", "long").add("terms", "binary").add("counts", "binary")

    def start():
        def run(texts):
            lengths, terms, counts = [], [], []
            for text in texts:
                words = terms_of(text)
                found = np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))
                t, n = np.unique(found[found >= 0], return_counts=True)
                lengths.append(len(words))
                terms.append(t.tobytes())
                counts.append(n.astype(np.int32).tobytes())
            return lengths, terms, counts

        return run

    return annotate(docs.select(named(key).alias("key"), named(text).alias("body")), "body", outputs, start).select("key", "n_terms", "terms", "counts")


def _document_counts(postings: DataFrame, n_terms: int) -> dict[int, int]:
    """Term number -> documents that hold it; counted in the tasks, one row a term and task is shuffled."""
    schema = T.StructType().add("term", "integer").add("n", "long")

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(flat_numbers(batch.column(0))[0], minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], schema.fieldNames())

    counted = postings.select("terms").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counted.collect()}


class Searcher:
    """Answers a group of items from blocks of documents."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k
        self.block = max(1, min(BLOCK_DOCS, CELLS // max((len(t) for _, t in items), default=1)))
        self.best = {number: [] for number, _ in items}  # rows (-score, id is null, id), in that order

    def add(self, keys: pa.Array, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> None:
        n = len(keys)
        order = np.empty(n, np.int64)
        order[pc.sort_indices(keys, null_placement="at_end").to_numpy()] = np.arange(n)
        docs = np.repeat(np.arange(n), sizes)
        m = 10 + 90 * lengths * self.n_docs // max(self.n_terms, 1)
        tf = counts.astype(np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        by = np.argsort((terms.astype(np.int64) << IMPACT_BITS) - impacts, kind="stable")
        terms, docs, impacts = terms[by], docs[by], impacts[by]
        starts = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        for number, asked in self.items:
            lists = [(docs[a:b], impacts[a:b] * w) for a, b, w in zip(starts[asked], starts[asked + 1], self.weights[asked], strict=True) if a < b and w]
            if not lists:
                continue
            held = self.best[number]
            floor = -held[-1][0] if len(held) == self.k else 1
            chosen, scores = best_documents(lists, n, order, self.k, floor)
            new = [(-s, key is None, key) for s, key in zip(scores.tolist(), keys.take(pa.array(chosen)).to_pylist(), strict=True)]
            self.best[number] = sorted(held + new, key=lambda r: r[:2] if r[1] else r)[: self.k]


def _search(postings: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, key and score: each task's k best documents of each item."""
    key = postings.schema["key"].dataType
    schema = T.StructType().add("item", "long").add("key", key).add("score", "long")
    arrow = pa.schema([("item", pa.int64()), ("key", to_arrow_type(key)), ("score", pa.int64())])

    def run(batches):
        searcher = Searcher(items, weights, n_docs, n_terms, k)
        held, n_held = [], 0

        def answer():
            block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            for at in range(0, block.num_rows, searcher.block):
                part = block.slice(at, searcher.block)
                terms, sizes = flat_numbers(part.column(2))
                searcher.add(part.column(0), part.column(1).to_numpy(), terms, flat_numbers(part.column(3))[0], sizes)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n_held += batch.num_rows
            if n_held >= searcher.block:
                answer()
                held, n_held = [], 0
        if n_held:
            answer()
        rows = [(number, r[2], -r[0]) for number, best in searcher.best.items() for r in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([], [], []), arrow, strict=True)], schema=arrow)

    return postings.filter(F.length("terms") > 0).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """item key, rank, document key and score of the ``k`` best documents of each item."""
    asked = items.select(named(item_key).alias("id"), named(item_text).alias("body"))

    def start():
        return lambda texts: ([sorted({w.decode() for w in terms_of(t)}) for t in texts],)

    asked = annotate(asked, "body", T.StructType().add("terms", T.ArrayType(T.StringType())), start).select("id", "terms")
    asked = cut_lineage(asked.withColumn("item", F.monotonically_increasing_id()))
    total = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    groups = -(-total // GROUP_TERMS)
    found = []
    for g in range(groups):
        held = asked.filter((F.pmod(F.xxhash64("item"), F.lit(groups)) == g) & (F.size("terms") > 0)).select("item", "terms").collect()
        numbers = {w.encode(): n for n, w in enumerate(sorted({w for r in held for w in r.terms}))}
        wanted = sorted((r.item, np.array([numbers[w.encode()] for w in r.terms], np.int64)) for r in held)
        postings = cut_lineage(_postings(docs, key, text, numbers))
        facts = postings.agg(F.count_if(F.col("n_terms") > 0).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
        counts = _document_counts(postings, len(numbers))
        weights = np.array([math.floor(1000 * math.log((2 * facts.docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(numbers))], np.int64)
        found.append(_search(postings, wanted, weights, facts.docs, facts.terms, k))
    if not found:
        empty = T.StructType().add("item", "long").add("key", docs.select(named(key)).schema[0].dataType).add("score", "long")
        found = [docs.sparkSession.createDataFrame([], empty)]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("item", "id"), "item").select(F.col("id").alias(item_key), "rank", F.col("key").alias(key), "score")
