"""What the headline numbers would be under other policies, computed from the ledger."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

SWITCHES = ("recompute_totals", "drop_returns", "admit_orphans", "admit_zero_future")


def policy_whatif(flagged: DataFrame) -> DataFrame:
    """All sixteen combinations of the four switches.

    The rows are first reduced to one line per combination of flags; only that small table
    is repeated per scenario.
    """
    grouped = flagged.select(
        (F.col("is_copy") | F.col("date_unparsed") | F.col("amount_unparsed")).alias("never"),
        F.col("is_copy").alias("copy"),
        (F.col("orphan_store") | F.col("orphan_product")).alias("orphan"),
        (F.col("zero_quantity") | F.col("is_future")).alias("odd"), "is_return",
        (F.col("orphan_store").cast("int") + F.col("orphan_product").cast("int")).alias("broken"),
        F.coalesce("parsed_total_amount", F.lit(0)).alias("reported"),
        F.coalesce("extended_amount", F.lit(0)).alias("computed"),
    ).groupBy("never", "copy", "orphan", "odd", "is_return").agg(
        F.count(F.lit(1)).alias("n"), F.sum("broken").alias("broken"),
        F.sum("reported").alias("reported"), F.sum("computed").alias("computed"))
    scenarios = F.array(*[
        F.struct(*[F.lit(bool(v)).alias(s) for s, v in zip(SWITCHES, values)])
        for values in product((0, 1), repeat=4)])
    each = grouped.withColumn("_s", F.explode(scenarios)).select("*", "_s.*")
    admitted = (
        ~F.col("never") & (~F.col("orphan") | F.col("admit_orphans"))
        & (~F.col("odd") | F.col("admit_zero_future")))
    loaded = admitted & ~(F.col("is_return") & F.col("drop_returns"))
    amount = F.when(F.col("recompute_totals"), F.col("computed")).otherwise(F.col("reported"))
    zero = F.lit(0)
    clean = ~F.col("never") & ~F.col("orphan") & ~F.col("odd")
    return each.groupBy(*SWITCHES).agg(
        F.sum(F.when(loaded, amount).otherwise(zero)).cast("double").alias("revenue"),
        F.sum(F.when(clean, F.col("reported")).otherwise(zero)).cast("double").alias("_base"),
        F.sum(F.when(loaded, F.col("n")).otherwise(zero)).alias("fact_rows"),
        F.sum(F.when(loaded, F.col("broken")).otherwise(zero)).alias("fk_violations"),
        F.sum(F.when(~admitted & ~F.col("copy"), F.col("n")).otherwise(zero)).alias("quarantined_rows"),
    ).withColumn("delta", F.round((F.col("revenue") - F.col("_base")) * 100) / 100).drop("_base")
