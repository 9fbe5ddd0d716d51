"""Operator 9: quality rules whose limits follow each language and source.

Every text is measured; documents that fail the fixed base rules (too few words, too
much repetition) are out. The others feed quantile sketches of three signals, one sketch
per language, source and signal: counts in buckets whose bounds grow by ``GAMMA``, so a
quantile is found to about half of GAMMA - 1 of its value. Sketches merge by adding
counts, in any order and with the same result; sums over sources and languages give the
sketches of a language and of the whole corpus, which stand in for groups with fewer
than ``LEAST`` documents. The limits are then joined to the documents.

There is no fixed cutoff. A text is a sample of its writer, so each signal has a margin
that shrinks with the text's length. The sketches hold value + margin, the most that a
document may stand for; that is not zero even where most documents have no such character
or line. A signal's limit is the upper quartile of these plus ``REACH`` times the spread
between the quartiles. A document is out if its value - margin, the least that it stands
for, exceeds the limit: texts with a few odd characters or short ones stay.

Defined cases: a null text has no words and fails; null languages or sources form a
group like any other; repeated rows are measured and counted each; an empty table gives
an empty table; other columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import WHITE, annotate, named, plain, restored

MEASURES = T.StructType()
for _name in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"):
    MEASURES.add(_name, "long")
SYMBOLS = b"#*$%&|<>"
#: What to leave out so that the length counts a text's code points outside white space.
NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))
WINDOW = 8
def _share(part: str, whole: str):
    """A share and twice the standard error of its count (one more, as none seen does not mean none)."""
    return F.try_divide(part, whole), F.try_divide(2 * F.sqrt(F.col(part) + 1), F.col(whole))


def _mean(total: str, count: str):
    """A mean and twice its standard error, words' lengths varying by half of their mean."""
    mean = F.try_divide(total, count)
    return mean, F.try_divide(mean, F.sqrt(count))


#: Signal -> its value and margin.
SIGNALS = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "lines": lambda: _share("n_dup_lines", "n_lines"),
    "length": lambda: _mean("word_chars", "n_words"),
}
GAMMA, LEAST, REACH = 1.02, 100, 3.0


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    # Equal keys are only candidates; the words decide.
    windows = [ids[p : p + WINDOW].tobytes() for p in at.tolist()]
    seen = Counter(windows)
    edge = np.zeros(len(ids) + 1, np.int64)
    for p, w in zip(at.tolist(), windows, strict=True):
        if seen[w] > 1:
            edge[p] += 1
            edge[p + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of ``MEASURES``."""

    def start():
        def run(texts):
            number = defaultdict()
            number.default_factory = number.__len__
            out = []
            for t in texts:
                raw = (t or "").encode()
                words = raw.split()
                ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
                lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
                out.append((len(words), len(raw.translate(None, NOT_COUNTED)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ids)))
            return list(zip(*out, strict=True)) if out else [[]] * len(MEASURES)

        return run

    return annotate(df, text, MEASURES, start)


def _base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def limits(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source and one limit for each signal, of every group with a document that passes the base rules."""
    values = F.array(*[F.struct(F.lit(s).alias("signal"), sum(signal()).alias("value")) for s, signal in SIGNALS.items()])
    bucket = F.when(F.col("s.value") > 0, F.ceil(F.log("s.value") / F.log(F.lit(GAMMA))))
    rows = measured.filter(~_base_failed()).select(named(lang).alias("lang"), named(source).alias("source"), F.explode(values).alias("s"))
    sketches = cut_lineage(rows.groupBy("lang", "source", "s.signal", bucket.alias("bucket")).agg(F.count("*").alias("n")))

    def quartiles(sketch: DataFrame, by: list[str], tag: str) -> DataFrame:
        whole = Window.partitionBy(*by, "signal")
        so_far = whole.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        ranked = sketch.groupBy(*by, "signal", "bucket").agg(F.sum("n").alias("n"))
        ranked = ranked.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(so_far)})
        # Bucket b holds values in (GAMMA^(b-1), GAMMA^b]; no bucket holds zero.
        middle = F.coalesce(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA), F.lit(0.0))
        at = {q: F.min(F.when(F.col("upto") >= q * F.col("total"), middle)) for q in (0.25, 0.75)}
        fence = ranked.groupBy(*by, "signal").agg((at[0.75] + REACH * (at[0.75] - at[0.25])).alias("fence"), F.max("total").alias("total"))
        wide = [F.max(F.when(F.col("signal") == s, F.col("fence"))).alias(f"{tag}_{s}") for s in SIGNALS]
        return fence.groupBy(*by).agg(F.max("total").alias(f"{tag}_n"), *wide)

    own = quartiles(sketches, ["lang", "source"], "own")
    tongue = quartiles(sketches, ["lang"], "lang").withColumnRenamed("lang", "tongue")
    every = quartiles(sketches, [], "all").first()  # one number for each signal
    whole = {s: F.lit(every[f"all_{s}"] if every else None).cast("double") for s in SIGNALS}
    joined = own.join(tongue, F.col("lang").eqNullSafe(F.col("tongue")))
    chosen = [F.when(F.col("own_n") >= LEAST, F.col(f"own_{s}")).when(F.col("lang_n") >= LEAST, F.col(f"lang_{s}")).otherwise(whole[s]).alias(f"limit_{s}") for s in SIGNALS]
    return joined.select("lang", "source", *chosen)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A measured table with base_failed and kept. ``measured`` is read twice: written, not computed."""
    bounds = cut_lineage(limits(measured, lang, source)).withColumnsRenamed({"lang": "limit_of_lang", "source": "limit_of_source"})
    same = named(lang).eqNullSafe(F.col("limit_of_lang")) & named(source).eqNullSafe(F.col("limit_of_source"))
    over = F.lit(False)
    for name, signal in SIGNALS.items():
        value, margin = signal()
        over |= value - margin > F.col(f"limit_{name}")
    verdicts = {"base_failed": _base_failed(), "kept": ~_base_failed() & ~F.coalesce(over, F.lit(False))}
    return measured.join(bounds, same, "left").withColumns(verdicts).drop(*bounds.columns)


def apply_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents of ``df`` that the rules keep, with their own columns."""
    rows, names = plain(df)
    verdicts = judge(cut_lineage(measure(rows, names[text])), names[lang], names[source])
    return restored(verdicts.filter("kept"), names)
