"""Operator 10: token counts from pre-token frequencies.

Each block of documents is reduced to per-document pre-token frequencies. The pieces of
a pre-token are counted once per distinct pre-token, joined to the frequencies, and summed, so no
id list of a document is ever made. The join stays inside the block: as a shuffle of
(document, pre-token, frequency) rows it would move several times the input.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted
each; an empty table gives an empty table; other columns pass through, and one named
like an output is replaced.
"""

from __future__ import annotations

from collections import Counter
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate
from .pieces import pieces

OUTPUTS = T.StructType().add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with n_bytes, n_tokens and whether the tokens exceed ``limit``."""

    def start():
        vocabulary = pieces(tokenizer)

        def count(texts):
            frequencies = [Counter(vocabulary.split(t)) for t in texts]
            ids = vocabulary.learn(set().union(*frequencies))
            lengths = {c: len(ids[c]) // 4 for f in frequencies for c in f}
            tokens = [sum(map(mul, f.values(), map(lengths.__getitem__, f))) for f in frequencies]
            return [len((t or "").encode()) for t in texts], tokens, [n > limit for n in tokens]

        return count

    return annotate(df, text, OUTPUTS, start)
