"""Operator 4: byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a block of documents form the corpus. An inverted index
maps each mergeable pair to the positions where it stands; merges are replayed over
all pre-tokens at once in rank order, and each merge touches only its two neighbours.
Pre-tokens do not influence each other, so the blocks give the ids a replay over the
whole corpus would give, without moving every token through a shuffle. A worker process
keeps the pre-tokens it has seen.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows
are encoded each; an empty table gives an empty table; other columns pass through,
and one named like the output is replaced.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import cache
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate, map_rows, named, without
from .pieces import NOT_PLAIN, pack, plain_pattern

SHIFT = 24
#: Distinct pre-tokens replayed together, and entries of either half of the cache.
REPLAYED, CACHE = 50_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Replay:
    """Applies the merges of a rank table to many pre-tokens together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("the rank table lacks a single byte")
        # Key of a pair: the first id shifted by SHIFT bits, and the second.
        self.pairs: dict[int, int] = {}
        self.byte_pairs = np.array([[self.rank(a, b) for b in self.single] for a in self.single])

    def rank(self, a: int, b: int) -> int:
        """The rank of two neighbours joined; -1 if the table lacks it."""
        found = self.pairs[a << SHIFT | b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return found

    def _first_index(self, flat: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """Positions of the byte pairs by rank."""
        ranks = self.byte_pairs[flat[:-1], flat[1:]]
        ranks[ends[:-1] - 1] = -1  # no pair reaches into the next word
        at = np.flatnonzero(ranks >= 0)
        order = at[np.argsort(ranks[at], kind="stable")]
        found, cuts = np.unique(ranks[order], return_index=True)
        return defaultdict(list, zip(found.tolist(), [x.tolist() for x in np.split(order, cuts[1:])], strict=True)) if len(at) else defaultdict(list)

    def run(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word (none of them empty)."""
        known, rank = self.pairs.get, self.rank
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        starts = (ends - lengths).tolist()
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol: list[int] = np.array(self.single)[flat].tolist()
        word: list[int] = np.repeat(np.arange(len(words)), lengths).tolist()
        place = np.arange(len(flat))
        after_, before_ = place + 1, place - 1
        after_[ends - 1] = -1
        before_[starts] = -1
        follow: list[int] = after_.tolist()
        before: list[int] = before_.tolist()
        index = self._first_index(flat, ends)
        queue = sorted(index)
        while queue:
            merged = heappop(queue)
            at = index.pop(merged, None)
            if at is None:
                continue
            at.sort()
            waiting = -1  # the word in which a lower or equal rank arose: its other positions come later
            for p in at:
                q = follow[p]
                a = symbol[p]
                if q < 0 or a < 0 or known(a << SHIFT | symbol[q]) != merged:
                    continue
                if word[p] == waiting:
                    if merged not in index:
                        heappush(queue, merged)
                    index[merged].append(p)
                    continue
                after, prior = follow[q], before[p]
                symbol[p], symbol[q], follow[p] = merged, -1, after
                if after >= 0:
                    before[after] = p
                    b = symbol[after]
                    r = known(merged << SHIFT | b)
                    if r is None:
                        r = rank(merged, b)
                    if r >= 0:
                        if r not in index:
                            heappush(queue, r)
                        index[r].append(p)
                        if r <= merged:
                            waiting = word[p]
                if prior >= 0:
                    b = symbol[prior]
                    r = known(b << SHIFT | merged)
                    if r is None:
                        r = rank(b, merged)
                    if r >= 0:
                        if r not in index:
                            heappush(queue, r)
                        index[r].append(prior)
                        if r <= merged:
                            waiting = word[p]
        out = []
        for p in starts:
            ids = []
            while p >= 0:
                ids.append(symbol[p])
                p = follow[p]
            out.append(ids)
        return out


class Encoder:
    """Texts to packed ids, with what it has seen."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = CACHE):
        self.replay, self.split, self.kept = Replay(ranks), regex.compile(pattern).findall, kept
        plain = plain_pattern(pattern)
        self.split_plain = plain.findall if plain else self.split
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> None:
        """Packed ids of pre-tokens; the older half of what is kept goes when it is full, but for what is wanted again."""
        if len(self.words) > self.kept:
            self.words, self.older = {}, self.words
        known, older, fresh = self.words, self.older, []
        for w in wanted:
            if w in known:
                continue
            found = older.get(w)
            if found is not None:
                known[w] = found
                continue
            rank = self.replay.ranks.get(raw := w.encode())
            if rank is None:
                fresh.append((w, raw))
            else:
                known[w] = pack([rank])
        for i in range(0, len(fresh), REPLAYED):
            some = fresh[i : i + REPLAYED]
            known.update(zip([w for w, _ in some], map(pack, self.replay.run([raw for _, raw in some])), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found = [(self.split if NOT_PLAIN.search(t) else self.split_plain)(t) if t else [] for t in texts]
        self._learn(set().union(*found))
        known = self.words.__getitem__
        return [b"".join(map(known, ws)) for ws in found]


@cache
def encoder_of(ranks: str, pattern: str, kept: int) -> Encoder:
    """The encoder of this worker process, with what its earlier tasks have seen."""
    return Encoder(read_ranks(ranks), pattern, kept)


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", kept: int = CACHE) -> DataFrame:
    """``df`` with ``ids``: the text's token ids as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of the rank file on every executor, ``pattern`` splits a
    text into pre-tokens. A pre-token that is itself in the table is one id. A worker keeps
    the ids of up to twice ``kept`` pre-tokens, which saves work and takes memory.
    """

    def start():
        encoder = encoder_of(ranks, pattern, kept)
        return lambda texts: (encoder.encode(texts),)

    return annotate(df, text, T.StructType().add("ids", "binary"), start)


def decode(df: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes of its packed ids (null ids: no bytes)."""

    def start():
        token = {rank: raw for raw, rank in read_ranks(ranks).items()}.__getitem__
        return lambda packed: ([b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in packed],)

    kept = without(df, ["decoded"])
    return map_rows(df, [named(c) for c in kept], kept, named(ids), T.StructType().add("decoded", "binary"), start)
