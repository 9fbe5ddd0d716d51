"""Operator 13: toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words, their first ``PREFIXES`` letters (so that
inflected forms share a term), and each of these once more if it occurs ``OFTEN`` times;
all are hashed into 2**``BITS`` buckets. The machine gives each bucket a weight and a vector of
``RANK`` numbers; the score of a text is the logistic function of the sum of the weights
and of the inner products of all pairs of its buckets' vectors, so that two terms may
count together for what neither does alone. It is trained by AdaGrad on mini-batches.

Training reads a bounded sample of the labelled rows: about ``ROWS`` keys of each label,
chosen by the hash of the key, one text a key (the greatest, if a key has several). The
driver holds the sample's buckets, and of these only ``TERMS``: half those whose share
differs most between the labels, half the most frequent. The bounds don't depend on the
corpus. Scoring is a map over all rows with the model in the tasks.

Defined cases: a null or empty text has no terms and the score of the bias alone; rows
without key or label are not learnt from; of several labels of a key the greatest counts;
without any labelled text all scores are 0.25; repeated rows are scored each; an empty
table gives an empty table; other columns pass through, and one named like the output is
replaced. Labels other than 0 and 1 count as 1 if above 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import annotate, flat_numbers, named

BITS, PREFIXES, OFTEN = 20, (4, 5, 6), 3
ROWS, TERMS, LEAST_DOCS = 6000, 8192, 3
RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 20, 256, 0.02, 1e-4, 1
#: Words a worker keeps the buckets of; longer words are looked up each time.
CACHE, CACHED_LENGTH = 200_000, 40
WORD = re.compile(r"[^\W\d_]+")
MASK = (1 << BITS) - 1


def _often(bucket: int) -> int:
    """The bucket that stands for a bucket's term occurring often."""
    return zlib.crc32(b"%d often" % bucket) & MASK


class Terms:
    """Buckets of texts: all of them, or the places of those in a model."""

    def __init__(self, places: np.ndarray | None = None):
        self.known = None if places is None else {int(b): k for k, b in enumerate(places)}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.often: dict[int, int] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
            found = tuple(zlib.crc32(t.encode()) & MASK for t in terms)
            if self.known is not None:
                found = tuple(b for b in found if b in self.known or self.level(b) in self.known)
            if len(word) <= CACHED_LENGTH:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def level(self, bucket: int) -> int:
        found = self.often.get(bucket)  # at most 2**BITS entries
        if found is None:
            found = self.often[bucket] = _often(bucket)
        return found

    def of_text(self, text: str | None) -> np.ndarray:
        counts: dict[int, int] = {}
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            for bucket in self.of_word(word):
                counts[bucket] = counts.get(bucket, 0) + n
        buckets = {*counts, *(self.level(b) for b, n in counts.items() if n >= OFTEN)}
        if self.known is not None:
            buckets = [self.known[b] for b in buckets if b in self.known]
        return np.sort(np.fromiter(buckets, np.int32, len(buckets)))


@dataclass
class Machine:
    """Bias, weights and vectors of the chosen buckets."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def _sums(self, places: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(rows, self.vectors[places, f], minlength=n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, (self.vectors * self.vectors).sum(axis=1)[places], minlength=n)
        linear = np.bincount(rows, self.weights[places], minlength=n)
        return self.bias + linear + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def scores(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return _logistic(self._sums(places, rows, len(sizes))[0])

    def train(self, places: np.ndarray, sizes: np.ndarray, labels: np.ndarray, costs: np.ndarray) -> None:
        """AdaGrad steps on the rows in mini-batches; a row's cost weighs its error."""
        rng, n = np.random.default_rng(SEED), len(self.buckets)
        self.vectors = rng.normal(0, 0.01, (n, RANK))
        starts = np.cumsum(sizes) - sizes
        past = [1e-8, np.full(n, 1e-8), np.full((n, RANK), 1e-8)]
        for _ in range(EPOCHS):
            for chosen in np.array_split(rng.permutation(len(sizes)), -(-len(sizes) // BATCH)):
                size = sizes[chosen]
                rows = np.repeat(np.arange(len(chosen)), size)
                own = places[np.arange(size.sum()) + np.repeat(starts[chosen] - (np.cumsum(size) - size), size)]
                raw, sums = self._sums(own, rows, len(chosen))
                error = (_logistic(raw) - labels[chosen]) * costs[chosen] / len(chosen)
                by_place = np.bincount(own, error[rows], minlength=n)
                met = np.bincount(own, minlength=n) > 0
                pulls = np.stack([np.bincount(own, (error[:, None] * sums)[rows, f], minlength=n) for f in range(RANK)], axis=1)
                steps = [error.sum(), by_place + DECAY * met * self.weights, pulls + (DECAY * met - by_place)[:, None] * self.vectors]
                past = [p + s * s for p, s in zip(past, steps, strict=True)]
                moves = [RATE * s / np.sqrt(p) for s, p in zip(steps, past, strict=True)]
                self.bias, self.weights, self.vectors = self.bias - float(moves[0]), self.weights - moves[1], self.vectors - moves[2]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """key, label and one text each of about ``ROWS`` keys of each label; ``cost`` evens out what was left out."""
    known = labels.select(named(key).alias("key"), (named(label) > 0).alias("label")).filter("key IS NOT NULL AND label IS NOT NULL")
    known = cut_lineage(known.groupBy("key").agg(F.max("label").alias("label")))
    n = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {v: min(1.0, ROWS / max(n.get(v, 0), 1)) for v in (True, False)}
    # A row of the rarer label weighs more, by the root of the proportion of all labelled rows.
    rare = max(1.0, n.get(False, 0) / max(n.get(True, 0), 1)) ** 0.5
    cost = {True: rare * share[False] / share[True], False: 1.0}
    at = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter(at < F.when(F.col("label"), share[True]).otherwise(share[False]))
    chosen = chosen.withColumn("cost", F.when(F.col("label"), cost[True]).otherwise(cost[False]))
    texts = docs.select(named(key).alias("key"), named(text).cast("string").alias("text"))
    # The sample is bounded, so it may go to all tasks, and the corpus is not shuffled.
    return texts.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max("text").alias("text"), F.max("label").alias("label"), F.max("cost").alias("cost"))


def _with_places(df: DataFrame, text: str, buckets: np.ndarray | None) -> DataFrame:
    """``df`` with ``places``: the buckets of each text (all, or their places in ``buckets``) as 32-bit integers."""

    def start():
        terms = Terms(buckets)
        return lambda texts: ([terms.of_text(t).tobytes() for t in texts],)

    return annotate(df, text, T.StructType().add("places", "binary"), start)


def _chosen_buckets(sample: DataFrame) -> np.ndarray:
    """The buckets that the machine has weights for, from their counts in the sample's texts by label."""
    schema = T.StructType().add("bucket", "integer").add("toxic", "long").add("other", "long")

    def run(batches):
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            buckets, sizes = flat_numbers(batch.column(0))
            label = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            counts += np.bincount(buckets + label * (1 << BITS), minlength=2 << BITS).reshape(2, -1)
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[1, some]), pa.array(counts[0, some])], schema.fieldNames())

    counted = sample.select("places", "label").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    table = counted.filter(F.col("toxic") + F.col("other") >= LEAST_DOCS).toArrow().sort_by("bucket")
    bucket, toxic, other = (c.to_numpy() for c in table.columns)
    n = sample.agg(F.count_if("label").alias("toxic"), F.count_if(~F.col("label")).alias("other")).first()
    expected = (toxic + other) * n.toxic / max(n.toxic + n.other, 1)
    contrast = np.abs(toxic - expected) / np.sqrt(expected + 1)
    return np.union1d(bucket[np.argsort(-contrast, kind="stable")[: TERMS // 2]], bucket[np.argsort(-(toxic + other), kind="stable")[: TERMS // 2]])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """The machine trained from a bounded sample of the labelled texts."""
    sample = cut_lineage(_with_places(labelled_sample(docs, labels, key, text, label), "text", None).select("text", "label", "cost", "places"))
    buckets = _chosen_buckets(sample)
    held = _with_places(sample.select("text", "label", "cost"), "text", buckets).select("label", "cost", "places").toArrow()
    held = held.sort_by([("label", "ascending"), ("places", "ascending")]).combine_chunks()
    y = held.column("label").to_numpy(zero_copy_only=False).astype(float)
    machine = Machine(buckets, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))), np.zeros(len(buckets)), np.zeros((len(buckets), RANK)))
    if len(y):
        places, sizes = flat_numbers(held.column("places").combine_chunks())
        machine.train(places, sizes, y, held.column("cost").to_numpy())
    return machine


def score(df: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``df`` with ``score``: how likely the text is toxic."""

    def start():
        terms = Terms(machine.buckets)

        def run(texts):
            places = [terms.of_text(t) for t in texts]
            sizes = np.array([len(p) for p in places], np.int64)
            return (machine.scores(np.concatenate(places), sizes),)

        return run

    return annotate(df, text, T.StructType().add("score", "double"), start)
