"""Operator 6: near-duplicates by SimHash and a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the number of differing bits, so pairs within
``DISTANCE`` = 2 bits are within 2 there. The 32 counts form four blocks of eight. A
distance of 2 changes at most two blocks, so a pair agrees on at least two whole blocks:
it shares one of six grid cells (a choice of two blocks and their counts). Pairs are
joined by cell, kept if their Manhattan distance allows it, and verified on the bits.

A cell with more than ``CROWD`` fingerprints is not paired. There each fingerprint
lists itself and its 64 one-bit neighbours, and those that list the same value are
linked to the least of them. Two fingerprints share a value exactly if they differ in
at most two bits, and at most 65 can share one, so no link is lost and no group grows.

Links between distinct fingerprints are contracted to components by alternating large
and small stars; every round is written. Copies of a fingerprint are never paired.

Defined cases: a null, empty or blank text has fingerprint zero and links like any
other; rows without an id take part, and a component's id is the least id in it (null
if none has one); repeated rows each get a row; an empty table gives an empty table;
other columns pass through, and one named like an output is replaced.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import annotate, named, numbered, restored

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints of a cell that are paired; larger cells take the exact way by shared neighbours.
CROWD = 64
#: Hashes turned to bits together.
CHUNK = 1 << 16
EVEN_BITS = 0x5555555555555555


def fingerprint(text: str | None) -> int:
    """The text's 64 majority bits, as a signed integer."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False))
    n = len(words) - SHINGLE + 1 if len(words) >= SHINGLE else min(1, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[k : k + CHUNK].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``fp`` (a bigint)."""
    return annotate(df, text, T.StructType().add("fp", "long"), lambda: lambda texts: ([fingerprint(t) for t in texts],))


def _popcounts(fp: str) -> Column:
    """The 32 segment counts, two bits each, in one bigint (bitwise: sums would overflow)."""
    low, high = F.col(fp).bitwiseAND(F.lit(EVEN_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _manhattan(a: str, b: str) -> Column:
    at = lambda c, k: F.shiftrightunsigned(c, 2 * k).bitwiseAND(F.lit(3))
    total = F.lit(0)
    for k in range(32):
        total += F.abs(at(a, k) - at(b, k))
    return total


def links(nodes: DataFrame) -> DataFrame:
    """a, b: links that connect all distinct ``fp`` within ``DISTANCE`` bits of each other.

    ``nodes`` is read several times: written, not computed.
    """
    block = lambda g: F.shiftrightunsigned("counts", 16 * g).bitwiseAND(F.lit(0xFFFF))
    cells = F.array(*[F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(block(g), 16) + block(h) for k, (g, h) in enumerate(combinations(range(4), 2))])
    placed = nodes.withColumn("counts", _popcounts("fp")).select("fp", "counts", F.explode(cells).alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut_lineage(placed.join(sizes, "cell"))

    paired = shared.filter(F.col("size") <= CROWD).drop("size")
    left = paired.select("cell", F.col("fp").alias("a"), F.col("counts").alias("a_counts"))
    right = paired.select("cell", F.col("fp").alias("b"), F.col("counts").alias("b_counts"))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = left.join(right, "cell").filter("a < b").filter(_manhattan("a_counts", "b_counts") <= DISTANCE).filter(differ <= DISTANCE)

    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    crowded = shared.filter(F.col("size") > CROWD).select("fp").distinct().select("fp", F.explode(flips).alias("value"))
    starred = crowded.select(F.col("fp").alias("b"), F.min("fp").over(Window.partitionBy("value")).alias("a")).filter("a < b")
    return near.select("a", "b").unionByName(starred.select("a", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node each node of ``edges`` (a, b) is connected to."""

    def contract(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
        joined = both.join(least, F.col("u") == F.col("at"))
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("at").alias("b")))
        return cut_lineage(out.filter("a != b").distinct())

    def state(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges, before = cut_lineage(edges), None
    while (now := state(edges)) != before:
        before = now
        edges = contract(contract(edges, large=True), large=False)
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def _roots(prints: DataFrame) -> DataFrame:
    """fp, root for each distinct fingerprint of a written table."""
    nodes = cut_lineage(prints.select("fp").distinct())
    found = components(links(nodes))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, a row for each row of ``df``."""
    prints = cut_lineage(fingerprints(df.select(named(key).alias("id"), named(text).alias("text")), "text").select("id", "fp"))
    roots = cut_lineage(_roots(prints))
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first")).join(roots, "fp")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named_components = roots.join(least, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named_components, "fp").select(F.col("id").alias(key), digits, "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the one with the least id.

    Rows without an id come after those with one; among rows of one id the first written stays.
    """
    rows, names = numbered(df)
    given = rows.select("rid", F.col(names[key]).alias("id"), F.col(names[text]).alias("text"))
    prints = cut_lineage(fingerprints(given).select("rid", "id", "fp"))
    order = F.struct(F.col("id").isNull().alias("unnamed"), "id", "rid")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("first")).join(_roots(prints), "fp")
    winners = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return restored(rows.join(winners, "rid", "left_semi"), names)
