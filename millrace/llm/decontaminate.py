"""Operator 7: benchmark decontamination by a distributed positional inverted index.

The training documents are indexed in shards, each a run of documents whose postings
fit one row: for every term of the shard, the sorted positions where it stands, counted
through all the shard's documents. The index is written to the shared folder.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is
one window). In each shard a window starts from the postings of its rarest term, moved
back by the term's offset, and is intersected with the moved postings of its other
terms, rarest first; a term the shard lacks ends the search at once. What is left are
the exact phrases. With ``slop`` the moved positions of a term may be up to that many
words apart from the rarest term's: proximity matches.

The distinct windows travel to the shards in blocks of at most ``BLOCK_WINDOWS``, a
stated query set against all shards; each block is one pass over the index, and the
blocks' matches are gathered by document.

Defined cases: a null or empty text has no words and no match; items without words
match nothing, items without an id are left out; rows of one item id are searched each
and count as one item; repeated documents are searched each; empty tables give no match
and no row; other columns of the documents pass through, and one named like an output
is replaced.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import blocks, named, plain, restored, small_batches

WINDOW = 10
#: Distinct windows that travel together: at most some 10 MB.
BLOCK_WINDOWS = 100_000
#: ASCII letters in lower case and digits stay, other ASCII becomes a space, all else stays.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
#: Empty positions between two documents of a shard, which no match may reach across.
GAP = 64
SHARD = "shard string, rids array<long>, starts binary, terms array<binary>, offsets binary, positions binary"
MATCH = "array<struct<item_id: string, start: long, n_words: long, exact: boolean>>"


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def build_index(rows: DataFrame) -> DataFrame:
    """The shards of ``rows`` (rid, text), written."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1):
                number = defaultdict()
                number.default_factory = number.__len__
                split = [words_of(t) for t in block.column(1).to_pylist()]
                counts = np.array([len(ws) for ws in split], np.int64)
                starts = np.concatenate([[0], np.cumsum(counts + GAP)])
                ids = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
                order = np.argsort(ids, kind="stable")
                positions = (order + GAP * np.repeat(np.arange(len(split)), counts)[order]).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(number)))]).astype("<u4")
                columns = [[uuid.uuid4().hex], [block.column(0).to_pylist()], [starts.astype("<u4").tobytes()], [list(number)], [offsets.tobytes()], [positions.tobytes()]]
                kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "rids", "starts", "terms", "offsets", "positions"])

    small_batches(rows)
    return cut_lineage(rows.mapInArrow(run, SHARD))


def windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_ids, words: each distinct window and the items that hold it, written."""

    def run(batches):
        for batch in batches:
            ids, lists = [], []
            for one, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                found = {tuple(words[k : k + WINDOW]) for k in range(max(1, len(words) - WINDOW + 1))} - {()}
                ids += [one] * len(found)
                lists += map(list, found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "words"])

    given = items.select(named(item).cast("string").alias("item_id"), named(text).cast("string").alias("text")).filter("item_id IS NOT NULL")
    return cut_lineage(given.mapInArrow(run, "item_id string, words array<binary>").groupBy("words").agg(F.collect_set("item_id").alias("item_ids")))


def _blocks_of(found: DataFrame) -> Iterator[list]:
    """The written windows in blocks that fit the driver."""
    n = found.count()
    parts = -(-n // BLOCK_WINDOWS)
    for k in range(parts):
        yield found.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == k).collect()


class Shard:
    """The postings of one row of the index."""

    def __init__(self, shard: str, rids: list[int | None], starts: bytes, terms: list[bytes], offsets: bytes, positions: bytes):
        self.shard, self.rids, self.starts = shard, rids, np.frombuffer(starts, "<u4").astype(np.int64)
        self.number = {t: k for k, t in enumerate(terms)}
        self.offsets, self.positions = np.frombuffer(offsets, "<u4"), np.frombuffer(positions, "<u4")

    def find(self, words: list[bytes], slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the window begins (by its rarest term), and whether each is the exact phrase."""
        none = np.empty(0, np.int64), np.empty(0, bool)
        terms = []
        for offset, w in enumerate(words):
            if (t := self.number.get(w)) is None:
                return none
            a, b = self.offsets[t], self.offsets[t + 1]
            terms.append((b - a, a, b, offset))
        terms.sort()
        _, a, b, offset = terms[0]
        at = self.positions[a:b].astype(np.int64) - offset
        exact = np.ones(len(at), bool)
        for _, a, b, offset in terms[1:]:
            moved = self.positions[a:b].astype(np.int64) - offset
            near = np.searchsorted(moved, at - slop)
            near[near == len(moved)] = len(moved) - 1
            keep = (moved[near] >= at - slop) & (moved[near] <= at + slop)
            if slop:
                same = np.minimum(np.searchsorted(moved, at), len(moved) - 1)
                exact &= moved[same] == at
            at, exact = at[keep], exact[keep]
            if not len(at):
                return none
        return at, exact


def search(index: DataFrame, block: list, slop: int = 0) -> DataFrame:
    """shard, place, rid, n_words, matches of one block of windows: a row for each indexed document."""
    if not 0 <= slop <= GAP - WINDOW:
        raise ValueError(f"slop must lie between 0 and {GAP - WINDOW}")

    def run(batches):
        wanted = [(w.words, w.item_ids) for w in queries.value]
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(*[c[k].as_py() for c in batch.columns])
                matches: dict[int, list] = defaultdict(list)
                for words, items in wanted:
                    at, exact = shard.find(words, slop)
                    docs = np.searchsorted(shard.starts, at + slop, side="right") - 1
                    for p, doc, e in zip(at.tolist(), docs.tolist(), exact.tolist(), strict=True):
                        start = max(0, p - int(shard.starts[doc]))
                        matches[doc] += [{"item_id": i, "start": start, "n_words": len(words), "exact": e} for i in items]
                places = range(len(shard.rids))
                columns = [[shard.shard] * len(places), list(places), shard.rids, np.diff(shard.starts) - GAP, [matches.get(d, []) for d in places]]
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("exact", pa.bool_())]))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "place", "rid", "n_words", "matches"])

    queries = index.sparkSession.sparkContext.broadcast(block)
    return index.mapInArrow(run, f"shard string, place long, rid long, n_words long, matches {MATCH}")


def contamination(rows: DataFrame, items: DataFrame, slop: int = 0, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """rid, n_words and matches of ``rows`` (rid, text): a row for each."""
    index = build_index(rows)
    per_block = [search(index, block, slop) for block in _blocks_of(windows(items, item, item_text))] or [search(index, [], slop)]
    found = per_block[0]
    if len(per_block) > 1:
        for more in per_block[1:]:
            found = found.unionByName(more)
        found = found.groupBy("shard", "place").agg(F.first("rid").alias("rid"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return found.select("rid", "n_words", "matches")


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df`` in which no benchmark window occurs.

    Rows are told apart by the 64-bit hash of their text, on which alone the verdict
    rests, so the table itself is not written again. ``df`` is read twice: written, not computed.
    """
    rows, names = plain(df)
    texts = F.col(names[text]).cast("string")
    hit = contamination(rows.select(F.xxhash64(texts).alias("rid"), texts.alias("text")), items, item=item, item_text=item_text)
    hit = cut_lineage(hit.filter(F.size("matches") > 0).select("rid").distinct())
    return restored(rows.withColumn("rid", F.xxhash64(texts)).join(hit, "rid", "left_anti"), names)
