"""Order-dependent results without sorting a whole key in one task.

A window over a hot key would put a third of the table in one task. Here each
key is cut into slices of its order; a small per-slice summary carries what the
earlier slices contribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def _join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns))
    match = [left[c].eqNullSafe(renamed[f"__{c}"]) for c in on]
    return left.join(renamed, match, how).drop(*(f"__{c}" for c in on))


def running_totals(df: DataFrame, keys: list[str], order: str, slice_: Column, sums: list[str]) -> DataFrame:
    """Adds ``run_<c>``: the sum of c over all rows of the key up to this one.

    One row per (keys, order). ``slice_`` must grow with ``order``.
    """
    sliced = df.withColumn("slice", slice_)
    upto = W.partitionBy(*keys, "slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    subtotals = sliced.groupBy(*keys, "slice").agg(*(F.sum(c).alias(c) for c in sums))
    carry = subtotals.select(*keys, "slice", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"carry_{c}") for c in sums))
    inner = sliced.withColumns({f"run_{c}": F.sum(c).over(upto) for c in sums})
    joined = _join_null_safe(inner, carry, [*keys, "slice"])
    totals = {f"run_{c}": F.col(f"run_{c}") + F.col(f"carry_{c}") for c in sums}
    return joined.withColumns(totals).drop("slice", *(f"carry_{c}" for c in sums))


def with_positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``: the 0-based position of the row in its key; (keys, order) should be unique.

    Rows are range-partitioned on (keys, order), so a hot key spreads over many
    tasks. The row ids are written out once: a second evaluation could cut the
    ranges elsewhere and disagree with the offsets.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = cut_lineage(ranged.withColumn("row_id", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("chunk", F.shiftright("row_id", 33))
    heads = numbered.groupBy(*keys, "chunk").agg(F.min("row_id").alias("head"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = heads.select(*keys, "chunk", "head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    joined = _join_null_safe(numbered, offsets, [*keys, "chunk"])
    return joined.withColumn("pos", F.col("skip") + F.col("row_id") - F.col("head")).drop("row_id", "chunk", "head", "skip")


def moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, block: int = 100_000) -> DataFrame:
    """Adds ``moving_mean`` over the last ``rows`` rows of the key.

    Positions are cut into blocks; each block also gets the last rows of the block
    before it, which its first windows reach back to.
    """
    if block < rows:
        raise ValueError("a block must hold at least one window")
    placed = with_positions(df, keys, order)
    own = F.floor(F.col("pos") / block)
    reaches_next = F.col("pos") % block >= block - (rows - 1)
    homes = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("block", F.explode(homes))
    frame = W.partitionBy(*keys, "block").orderBy("pos").rowsBetween(-(rows - 1), 0)
    return spread.withColumn("moving_mean", F.avg(value).over(frame)).filter(F.col("block") == own).drop("block", "pos")


def as_of(events: DataFrame, facts: DataFrame, keys: list[str], at: str, values: list[str], slice_: Column) -> DataFrame:
    """Each event with the values of the last fact at or before it.

    ``slice_`` is an expression over ``at``, present in both inputs.
    """
    packed = F.struct(F.col(at).alias("fact_at"), *values)
    rows = events.withColumn("fact", F.lit(None).cast(facts.select(packed.alias("f")).schema["f"].dataType)).withColumn("kind", F.lit(1))
    marks = facts.select(*keys, at, packed.alias("fact"), F.lit(0).alias("kind"))
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("slice", slice_)
    within = W.partitionBy(*keys, "slice").orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    ends = both.groupBy(*keys, "slice").agg(F.max("fact").alias("last_fact"))
    carry = ends.select(*keys, "slice", F.last("last_fact", ignorenulls=True).over(earlier).alias("carry"))
    filled = both.withColumn("fact", F.last("fact", ignorenulls=True).over(within)).filter("kind = 1")
    joined = _join_null_safe(filled, carry, [*keys, "slice"])
    found = joined.withColumn("fact", F.coalesce("fact", "carry"))
    return found.select(*events.columns, "fact.*")


def sessions(df: DataFrame, keys: list[str], at: str, gap_seconds: int, measures: dict[str, Column]) -> DataFrame:
    """Runs of rows of a key with no pause longer than the gap.

    Two rows of one gap-wide time slice always share a session, so rows are first
    folded to one per slice with plain sums; the window then sees slices only.
    """
    at_us = F.unix_micros(F.col(at).cast("timestamp"))
    folded = (
        df.withColumn("slice", F.floor(at_us / (gap_seconds * 1_000_000)))
        .groupBy(*keys, "slice")
        .agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(m) for m, e in measures.items()))
    )
    line = W.partitionBy(*keys).orderBy("slice")
    pause = F.unix_micros(F.col("lo").cast("timestamp")) - F.unix_micros(F.lag("hi").over(line).cast("timestamp"))
    starts = F.when(pause <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = folded.withColumn("starts", starts).withColumn("session_no", F.sum("starts").over(line))
    return numbered.groupBy(*keys, "session_no").agg(
        F.min("lo").alias("session_start"),
        F.max("hi").alias("session_end"),
        F.sum("n").alias("n_rows"),
        *(F.sum(m).alias(m) for m in measures),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], width: int) -> DataFrame:
    """Interpolated percentiles of an integer measure, ``p<100*q>`` per key.

    Values are counted before the shuffle and ranked through running totals, where
    the built-in `percentile` would hold all values of a key in one buffer. A slice
    has at most ``width`` distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, keys, value, F.floor(F.col(value) / width), ["n"])
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ranked = _join_null_safe(ranked, totals, keys)

    def at_rank(rank):
        return F.max(F.when((F.col("run_n") - F.col("n") <= rank) & (rank < F.col("run_n")), F.col(value)))

    columns = []
    for q in probabilities:
        rank = F.lit(q) * (F.col("total") - 1)
        name = f"p{q * 100:g}".replace(".", "_")
        columns += [
            at_rank(F.floor(rank)).alias(f"{name}_lo"),
            at_rank(F.ceil(rank)).alias(f"{name}_hi"),
            F.max(rank - F.floor(rank)).alias(f"{name}_part"),
        ]
    found = ranked.groupBy(*keys).agg(*columns, F.max("total").alias("n_rows"))
    names = [f"p{q * 100:g}".replace(".", "_") for q in probabilities]
    blend = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n) for n in names]
    return found.select(*keys, "n_rows", *blend)


def _with_first_positions(placed: DataFrame, keys: list[str], value: str, block: int) -> DataFrame:
    """Adds ``first_pos``: where the run of equal values begins that a row at ``pos`` belongs to.

    Positions are cut into blocks. Inside a block a run begins where the value changes;
    for a run that reaches in from the blocks before, one row a block carries where it
    began. Nothing is joined on the value, of which one may fill a third of the rows.
    """
    blocks = placed.withColumn("block", F.floor(F.col("pos") / block))
    head = F.col("block") * block
    runs = blocks.groupBy(*keys, "block", value).agg(F.min("pos").alias("begins"))
    held = F.struct(F.col(value).alias("value"))  # a null value is a value too
    ends = runs.groupBy(*keys, "block").agg(F.min_by(held, "begins").alias("opening"), F.max_by(held, "begins").alias("closing"), F.max("begins").alias("latest"))
    chain = W.partitionBy(*keys).orderBy("block")
    new = F.lag("closing").over(chain).isNull() | ~F.col("opening").eqNullSafe(F.lag("closing").over(chain))
    ends = ends.withColumns({"opened": F.when(new, head), "latest": F.when(F.col("latest") > head, F.col("latest"))})
    open_at_end = F.last(F.coalesce("latest", "opened"), ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1))
    carried = ends.select(*keys, "block", F.coalesce("opened", open_at_end).alias("carry"))
    inside = blocks.withColumn("inside", F.min("pos").over(W.partitionBy(*keys, "block", value)))
    joined = _join_null_safe(inside, carried, [*keys, "block"])
    return joined.withColumn("first_pos", F.when(F.col("inside") > head, F.col("inside")).otherwise(F.col("carry"))).drop("block", "inside", "carry")


def deciles(df: DataFrame, keys: list[str], value: str, tiebreak: list[str], tiles: int = 10, block: int = 100_000) -> DataFrame:
    """Adds ``tile`` (ntile) and ``percent_rank`` of the value within its key."""
    placed = with_positions(df, keys, [value, *tiebreak])
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    ranked = _join_null_safe(_with_first_positions(placed, keys, value, block), totals, keys)
    small = F.floor(F.col("total") / tiles)
    large = F.col("total") % tiles  # this many tiles have one row more
    in_large = F.col("pos") < large * (small + 1)
    tile = F.when(in_large, F.floor(F.col("pos") / (small + 1))).otherwise(large + F.floor((F.col("pos") - large * (small + 1)) / small))
    share = F.when(F.col("total") > 1, F.col("first_pos") / (F.col("total") - 1)).otherwise(0.0)
    return ranked.withColumn("tile", (tile + 1).cast("int")).withColumn("percent_rank", share).drop("pos", "first_pos", "total")


def interval_profile(df: DataFrame, keys: list[str], start: str, end: str, slice_unit: str = "minute") -> DataFrame:
    """Per key and instant: intervals started before and up to it, ended up to it.

    Intervals are half-open, so an end at an instant precedes a start. One without an
    end is still running.
    """
    point = F.explode(F.array(
        F.struct(F.col(start).alias("instant"), F.lit(1).alias("started"), F.lit(0).alias("ended")),
        F.struct(F.col(end).alias("instant"), F.lit(0).alias("started"), F.lit(1).alias("ended")),
    ))
    points = df.select(*keys, point.alias("p")).select(*keys, "p.*").filter("instant IS NOT NULL")
    instants = points.groupBy(*keys, "instant").agg(F.sum("started").alias("started"), F.sum("ended").alias("ended"))
    profile = running_totals(instants, keys, "instant", F.date_trunc(slice_unit, "instant"), ["started", "ended"])
    return profile.withColumn("started_before", F.col("run_started") - F.col("started"))
