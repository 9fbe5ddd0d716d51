"""Character n-grams and word tokens of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def distinct_grams(chars: Column, n: int) -> Column:
    """Distinct n-grams of an array of characters; a shorter text is one gram.

    The array is joined with itself shifted by one, n - 1 times, so the work is linear
    in the text however the optimizer places the expression. `substring` or an index
    into the array inside a lambda would walk or rebuild the text for each gram.
    """
    grams = chars
    for k in range(1, n):
        shifted = F.slice(chars, F.lit(k + 1), F.size(chars))
        grams = F.zip_with(grams, shifted, lambda g, c: F.concat(g, c))
    long = F.filter(grams, lambda g: g.isNotNull())  # the shift leaves nulls at the end
    short = F.filter(F.array(F.array_join(chars, "")), lambda g: g != "")
    return F.array_distinct(F.when(F.size(chars) >= n, long).otherwise(short))


def with_grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, grams): the distinct lower-cased n-grams of each text."""
    chars = df.select(key, F.split(F.lower(F.col(text)), "").alias("chars"))
    return chars.select(key, distinct_grams(F.col("chars"), n).alias("grams"))


def rows_of(array: str | Column, name: str) -> Column:
    """The elements as rows. Filter on ``name`` being set.

    The plain `explode` also filters its input on the array's size, which evaluates
    the array expression a second time per text.
    """
    return F.explode_outer(array).alias(name)


def text_grams(text: str, n: int) -> list[str]:
    """The same grams for a search keyword."""
    low = text.lower()
    return sorted({low[i : i + n] for i in range(len(low) - n + 1)} or {low})


#: Characters of texts that are numbered together.
PIECE = 2_000_000
_CHARACTERS = 0x110000


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow batch (null: empty), some ``PIECE`` characters at a time, each with its first row."""
    texts, size, first = [], 0, 0
    for at, text in enumerate(batch.column(column)):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= PIECE:
            yield first, texts
            texts, size, first = [], 0, at + 1
    if texts:
        yield first, texts


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")


def _number(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """From 1 the place of each code among the sorted known ones, 0 if it is none of them."""
    if not len(known):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, at + 1, 0)


class GramNumbers:
    """Numbers of the n-grams of given texts: n characters in a row, as one integer each.

    Characters are numbered by the texts' own alphabet, and the code of a gram is its
    characters' numbers in one integer. Where these would not fit, the beginnings of
    grams are numbered first, so that no two grams share a code.
    """

    def __init__(self, points: np.ndarray, n: int):
        self.n, self.alphabet, self.known, self._ranks = n, np.unique(points), {}, None
        self._given = self._codes(points, learn=True)

    def _codes(self, points: np.ndarray, learn: bool = False) -> np.ndarray:
        if self._ranks is None:
            self._ranks = np.zeros(_CHARACTERS, np.int64)
            self._ranks[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        ranks, size = self._ranks[points], len(self.alphabet) + 1
        places = max(len(points) - self.n + 1, 0)
        codes, span = ranks[:places], size
        for k in range(1, self.n):
            if learn and span * size >= 1 << 63:
                self.known[k] = np.unique(codes)
            if k in self.known:
                codes, span = _number(codes, self.known[k]), len(self.known[k]) + 1
            codes, span = codes * size + ranks[k : k + places], span * size
        return codes

    def __getstate__(self):
        return self.__dict__ | {"_ranks": None, "_given": None}

    def given(self) -> np.ndarray:
        """The code at each place of the given texts."""
        return self._given

    def of(self, points: np.ndarray) -> np.ndarray:
        """The code at each place of other texts; that of a gram the given texts lack is none of theirs."""
        return self._codes(points)


def distinct_codes(codes: np.ndarray, lengths: list[int], n: int) -> list[np.ndarray]:
    """The different codes of each text, of the codes at all places of the joined texts."""
    out, start = [], 0
    for length in lengths:
        own = np.sort(codes[start : start + max(length - n + 1, 0)])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        start += length
    return out


def gram_counts(texts: list[str], n: int) -> Iterator[tuple[str, int]]:
    """Each distinct n-gram of each text, counted over the texts; a shorter text is one gram."""
    yield from Counter(t for t in texts if 0 < len(t) < n).items()
    points = code_points(texts)
    codes = GramNumbers(points, n).given()
    grams, counts = np.unique(np.concatenate(distinct_codes(codes, [len(t) for t in texts], n)), return_counts=True)
    place = np.zeros(len(grams) + 1, np.int64)
    place[_number(codes, grams)] = np.arange(len(codes))  # any place of a gram tells its characters
    held = points[place[1:, None] + np.arange(n)].tobytes().decode("utf-32-le")
    yield from zip([held[i : i + n] for i in range(0, len(held), n)], counts.tolist(), strict=True)
