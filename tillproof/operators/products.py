"""Product cleaning: exact copies, conflicting keys, missing prices and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.config import RunConfig
from tillproof.functions.money import parse_price
from tillproof.functions.text import normalise_frame, normalise_text
from tillproof.operators.medians import group_median
from tillproof.scale import flag_repeats, lookup
from tillproof.schemas import MONEY, PRODUCTS_CLEAN, RAW_COLUMNS, require_columns

COLUMNS = RAW_COLUMNS["products"]

# How a column of a conflicting key is settled. Columns not named take the first non-null.
CONFLICT_POLICY = {"unit_price": "max_number"}


def drop_exact_duplicates(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """First copy of each equal row; copies combine before the shuffle."""
    return df.groupBy(*columns).agg(F.min("source_row").alias("source_row"))


def exact_copies(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The rows drop_exact_duplicates leaves out."""
    return flag_repeats(df, list(columns), "source_row", "is_copy").filter("is_copy").drop("is_copy")


def _settle(name: str, rule: str, number: Column) -> Column:
    if rule == "max_number":
        return F.max_by(F.col(name), F.struct(number, -F.col("source_row")))
    if rule == "first_value":
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("source_row")))
    raise ValueError(f"unknown conflict rule {rule!r}")


def resolve_conflicts_by_policy(
    df: DataFrame, key: str = "product_id", policy: dict[str, str] | None = None,
) -> DataFrame:
    """One row per key, settled column by column, with the names of the columns that differed.

    Everything is a mergeable aggregate, so a repeated key never gathers in one task. Rows
    without a key stand for different things and are left to ``keyless_rows``.
    """
    policy = CONFLICT_POLICY if policy is None else policy
    others = [c for c in COLUMNS if c != key]
    df = df.filter(F.col(key).isNotNull()).withColumn("_price", parse_price(F.col("unit_price"), F.col(key)))
    price = F.col("_price")
    aggregates = [F.count(F.lit(1)).alias("group_rows"), F.min("source_row").alias("source_row")]
    for c in others:
        aggregates.append(_settle(c, policy.get(c, "first_value"), price).alias(c))
        held = F.count(c)
        aggregates.append(
            (((held > 0) & (held < F.count(F.lit(1))))
             | F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(f"_differs_{c}"))
    first_top = F.struct(price, -F.col("source_row"))
    aggregates += [
        F.max(price).alias("_top"), F.max_by(price, first_top).alias("_elected"),
        F.max_by("source_row", first_top).alias("elected_row"),
        (F.max(price) - F.min(price)).cast(MONEY).alias("price_delta")]
    grouped = df.groupBy(key).agg(*aggregates)
    differing = F.concat_ws(",", *[F.when(F.col(f"_differs_{c}"), F.lit(c)) for c in others])
    lower = F.coalesce(F.col("_elected") != F.col("_top"), F.lit(False))
    checked = F.when(lower, F.raise_error(F.lit("elected price is not the maximum")).cast("string")).otherwise(
        F.col("unit_price"))
    return grouped.select(
        key, *[F.col(c) if c != "unit_price" else checked.alias(c) for c in others], "source_row",
        "group_rows", "elected_row", differing.alias("conflicting_columns"),
        F.col("_differs_unit_price").alias("price_conflict"), "price_delta")


def conflict_evidence(df: DataFrame, key: str = "product_id") -> DataFrame:
    """Every version of every conflicting key; ``df`` holds no exact copies any more."""
    settled = resolve_conflicts_by_policy(df, key).filter("group_rows > 1").select(
        key, "conflicting_columns", "price_delta", "group_rows", "elected_row")
    return lookup(df, settled, [key], "inner").withColumn(
        "is_elected", F.col("source_row") == F.col("elected_row")).drop("elected_row")


def resolve_duplicate_keys(df: DataFrame) -> DataFrame:
    """Exact copies first, then conflicts. The other order would hide the conflicts."""
    return resolve_conflicts_by_policy(drop_exact_duplicates(df))


def impute_group_median(df: DataFrame, group: str = "category", price: str = "price") -> DataFrame:
    """PR-04: a price that is missing or not above zero takes the median of its own observed
    category, else of all valid prices."""
    valid = df.filter(F.col(price) > 0)
    by_group = group_median(valid.filter(F.col(group).isNotNull()), [group], price, "_group_median")
    overall = group_median(valid.withColumn("_all_rows", F.lit(1)), ["_all_rows"], price, "_median")
    bad = F.coalesce(F.col(price) <= 0, F.lit(True))
    return lookup(df, by_group, [group], "left").withColumns({
        "price_is_imputed": bad,
        price: F.when(bad, F.coalesce("_group_median", overall.select("_median").scalar()))
        .otherwise(F.col(price)).cast(MONEY),
    }).drop("_group_median")


def impute_literal(df: DataFrame, column: str = "category", label: str = "Unknown") -> DataFrame:
    """PR-03: a named bucket for what is missing, with a flag."""
    text = normalise_text(F.col(column))
    return df.withColumns({
        f"{column}_is_imputed": text.isNull(), column: F.coalesce(text, F.lit(label))})


def clean_products(raw: DataFrame, config: RunConfig) -> DataFrame:
    """Text, exact copies, conflicts, price, category, then the typed columns."""
    require_columns(raw, COLUMNS, "products")
    settled = resolve_duplicate_keys(normalise_frame(raw, COLUMNS))
    priced = settled.withColumn("price", parse_price(F.col("unit_price"), F.col("product_id")))
    filled = impute_literal(impute_group_median(priced), "category", config.unknown_label)
    return filled.withColumnRenamed("price", "list_unit_price").select(*PRODUCTS_CLEAN)


def product_defects(raw: DataFrame) -> DataFrame:
    """(code, dataset, source_row, key, disposition) for every source row a product rule touched."""
    rows = normalise_frame(raw, COLUMNS)
    unique = drop_exact_duplicates(rows)
    settled = resolve_conflicts_by_policy(unique).withColumn(
        "price", parse_price(F.col("unit_price"), F.col("product_id")))
    base = [F.col("source_row"), F.col("product_id").alias("row_key")]

    def touched(df: DataFrame, code: str, disposition: Column) -> DataFrame:
        return df.select(F.lit(code).alias("code"), *base, disposition.alias("disposition"))

    evidence = F.lit("evidence")
    copies = touched(exact_copies(rows), "PR-01", F.lit("dropped"))
    conflicts = touched(
        conflict_evidence(unique), "PR-02", F.when(~F.col("is_elected"), "dropped").otherwise(evidence))
    nameless = touched(settled.filter("category is null"), "PR-03", evidence)
    free = touched(settled.filter("price is null or price <= 0"), "PR-04", evidence)
    conflicts = conflicts.withColumn("counted", F.col("disposition") == "dropped")
    copies, nameless, free = (d.withColumn("counted", F.lit(True)) for d in (copies, nameless, free))
    return copies.unionByName(conflicts).unionByName(nameless).unionByName(free).withColumn(
        "dataset", F.lit("products"))
