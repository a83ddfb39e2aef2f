"""Exact group medians without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillproof.scale import written
from tillproof.schemas import MONEY

# Bits of the value that one level of the search settles. A histogram has at most 2^LEVEL buckets.
LEVEL = 14


def group_median(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Interpolated median per non-null group of a money column, by counts.

    Equal values are counted before the shuffle. The two middle places of every group are then found by
    bisection: a histogram of the highest bits of the value shows in which bucket a place lies, the
    histogram of the next bits inside that bucket where exactly, and so on. Every histogram is a
    map-side aggregate, and only one with at most 2^LEVEL rows per group and place is put in order, so
    no task sees all distinct values of a group, however many there are.
    """
    cents = F.round(F.col(value).cast("decimal(20,2)") * 100).cast("long")
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*groups, cents.alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ends = counts.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    if ends.low is None:
        return df.select(*groups).limit(0).withColumn(name, F.lit(None).cast(MONEY))
    shifted = counts.withColumn("_v", F.col("_v") - F.lit(ends.low))
    levels = max(1, -(-(ends.high - ends.low).bit_length() // LEVEL))
    totals = shifted.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    # Of an odd number both middle places are one.
    state = totals.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(k).alias("_which"), F.floor((F.col("_all") + k) / 2).alias("_rank")) for k in (1, 2)])).alias("_p")).select(
        *groups, "_p.*", F.lit(0).cast("long").alias("_prefix"))
    keys = [*groups, "_which"]
    for level in reversed(range(levels)):
        inside = shifted.withColumn("_prefix", F.shiftright("_v", LEVEL * (level + 1))).join(
            written(state, "median-search"), [*groups, "_prefix"])
        digits = inside.groupBy(*keys, "_rank", F.shiftright("_v", LEVEL * level).alias("_next")).agg(F.sum("_n").alias("_n"))
        running = digits.withColumn("_to", F.sum("_n").over(W.partitionBy(*keys).orderBy("_next")))
        before = F.col("_to") - F.col("_n")
        state = running.filter((before < F.col("_rank")) & (F.col("_to") >= F.col("_rank"))).select(
            *keys, (F.col("_rank") - before).alias("_rank"), F.col("_next").alias("_prefix"))
    middle = (F.sum("_prefix") / 2 + F.lit(ends.low)) / 100
    return state.groupBy(*groups).agg(F.round(middle.cast("decimal(24,4)"), 2).cast(MONEY).alias(name))
