"""Operator 1: main text of pages by consensus host paths.

Every page's containers are scored by the text they stand for. A container's path is
the tags, classes and ids from the page's root to it, with digits generalised. Each page
gives its containers' shares of its score as votes; Spark adds them up for each host and
path, and the path with the most votes wins the host. The pages are then extracted
again: the blocks inside the elements on the winning path, without menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments. A page without
such an element, or whose own best container scores ``CLEARLY`` times more, uses its own.

Classes and ids make an element a suspect only. What its name says of the article or the
page's frame, how much of the page's text it holds, and how much of that is links, decide;
a form around an article element is the page's frame; and where nothing is left, suspects
that may hold the article are read after all (`pages.Page`).

Defined cases: null or empty html gives an empty text; pages without a host vote
together; of equal votes the smaller path wins; repeated pages vote each; an empty table
gives an empty table; other columns pass through, and one named like the output is
replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import blocks, map_rows, named, small_batches, without
from .pages import Page
from .url_filter import host_and_path

#: A page's votes; and by how much a page's own container must win over the host's.
VOTES, CLEARLY = 1000, 3


def winning_paths(rows: DataFrame) -> DataFrame:
    """host, path: the path with the most votes of each host in ``rows`` (host, html)."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1):
                votes: Counter = Counter()
                for host, source in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    page = Page(source)
                    totals = page.scores()
                    if whole := sum(totals):
                        for path, score in zip(page.path, totals, strict=True):
                            if score:
                                votes[host, path] += VOTES * score // whole
                hosts, paths = zip(*votes, strict=True) if votes else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])

    small_batches(rows)
    votes = rows.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # The least of (-votes, path): most votes first, then the smaller path.
    first = F.min(F.struct((-F.col("votes")).alias("votes"), "path"))
    return votes.groupBy("host").agg(first.alias("first")).select("host", F.col("first.path").alias("path"))


def extract(source: str | None, path: str | None) -> str:
    """The page's text by its host's winning path."""
    page = Page(source)
    totals = page.scores()
    best = max(range(len(totals)), key=totals.__getitem__)
    roots = {k for k, p in enumerate(page.path) if p == path}
    if not roots or CLEARLY * sum(totals[k] for k in roots) < totals[best]:
        roots = {best}
    return page.text(roots)


def main_text(df: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``df`` with ``text``: the page's main text, its blocks one a line."""
    host = host_and_path(named(url))[0].alias("host")
    winners = cut_lineage(winning_paths(df.select(host, named(source).cast("string").alias("html"))))
    winners = winners.withColumnsRenamed({"host": "path_of_host", "path": "host_path"})
    kept = without(df, ["text"])
    rows = df.select(host, F.struct(*[named(c) for c in kept]).alias("row"), named(source).cast("string").alias("html"))
    joined = rows.join(winners, F.col("host") == F.col("path_of_host"), "left")

    def start():
        return lambda pairs: ([extract(*p.split("\x00", 1)[::-1]) if p is not None else "" for p in pairs],)

    # The path travels before the html in one text column.
    both = F.concat(F.coalesce("host_path", F.lit("")), F.lit("\x00"), "html")
    columns = [F.col("row").getField(c) for c in kept]
    return map_rows(joined, columns, kept, both, T.StructType().add("text", "string"), start)
