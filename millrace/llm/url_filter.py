"""Operator 2: URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path) fits urls of its host and all subdomains whose path starts with the
rule's. Its canonical key is the reversed host, a separator and the path; the rule then
covers the interval of keys that start with its own. A url has one key for each of its
host's suffixes, and a rule fits it exactly if one of these keys lies in its interval.

Such intervals nest. The stack that a sweep over the sorted keys holds at a rule's start
is the rule and the rules around it; every rule row carries it. The sweep sorts rules
and keys together by ranges, so no key or host has to fit one task; the stack in force
at a key is that of the last rule at or before it, of which the entries that have ended
are dropped. What a range inherits is the last stack of the ranges before it.

The longest rule wins (by host and path together; of equally long ones that with the
longer host; of equal ones a block). Urls that no rule fits get the default verdict.

Defined cases: a null url, or one without "://", has an empty host and path and fits no
rule; rules with a null or empty host or another verdict are left out, a null path is
empty; repeated urls are swept once and each row gets the verdict; an empty table gives
an empty table, no rules give the default; other columns pass through, and one named
like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import named, without

OUTPUTS = ["host", "path", "rule", "verdict"]
#: Ends the host in a key; it sorts before every other character, and no url holds it.
END = "\x00"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end; path: up to "?", "#" or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def stacked(rules: DataFrame, host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """key, stack: each rule's key, and the rules around and including it from the outermost in."""
    given = rules.select(lower_ascii(named(host)).alias("host"), F.coalesce(named(path), F.lit("")).alias("path"), named(verdict).alias("verdict"))
    given = given.filter("host != '' AND verdict IN ('allow', 'block')")
    one = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = one.select(F.concat(_reversed(F.col("host")), F.lit(END), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))
    entry = F.struct(F.length("outer").alias("size"), F.col("outer").alias("key"), "rule", "verdict", "host_length").alias("entry")
    # A rule around another has a key that is a prefix of the other's key.
    shortest = F.instr("key", END)
    prefixes = keyed.select("key", F.explode(F.transform(F.sequence(shortest, F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    around = keyed.select(F.col("key").alias("outer"), "rule", "verdict", "host_length")
    return prefixes.join(around, F.col("prefix") == F.col("outer")).select("key", entry).groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct (host, path) of ``urls`` that a rule fits."""
    order = ["key", "kind", "host", "path"]
    labels = F.reverse(F.split("host", r"\.", -1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(END), F.col("path")))
    keys = urls.filter("host != ''").select("host", "path").distinct().select(F.explode(suffixes).alias("key"), F.lit(1).alias("kind"), "host", "path")
    starts = rules.select("key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "stack")
    both = starts.unionByName(keys, allowMissingColumns=True).repartitionByRange(*order)
    # Written, so that both readings below see the same ranges.
    swept = cut_lineage(both.withColumn("part", F.spark_partition_id()))

    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = swept.groupBy("part").agg(F.max_by(F.when(F.col("kind") == 0, F.col("stack")), F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    carried = ends.select("part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    held = swept.withColumn("held", F.last("stack", ignorenulls=True).over(so_far)).filter("kind = 1").drop("stack").join(carried, "part")
    active = F.filter(F.coalesce("held", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    top = held.withColumn("top", F.try_element_at(active, F.lit(-1))).filter("top IS NOT NULL")
    longest = F.max_by("top", F.struct(F.length("top.rule"), "top.host_length"))
    return top.groupBy("host", "path").agg(longest.alias("top")).select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, the rule in force and its verdict. ``rules`` has host, path, verdict."""
    host, path = host_and_path(named(url))
    parsed = df.select(host.alias("host"), path.alias("path"), *[named(c) for c in without(df, OUTPUTS)])
    found = match(parsed, stacked(rules)).withColumnsRenamed({"host": "rule_of_host", "path": "rule_of_path", "rule": "found_rule", "verdict": "found_verdict"})
    whole = F.struct(*[named(c) for c in without(df, OUTPUTS)]) if without(df, OUTPUTS) else F.struct(F.lit(None).alias("none"))
    rows = parsed.select("host", "path", whole.alias("row"))
    joined = rows.join(found, (F.col("host") == F.col("rule_of_host")) & (F.col("path") == F.col("rule_of_path")), "left")
    kept = [F.col("row").getField(c).alias(c) for c in without(df, OUTPUTS)]
    return joined.select(*kept, "host", "path", F.col("found_rule").alias("rule"), F.coalesce("found_verdict", F.lit(default)).alias("verdict"))
