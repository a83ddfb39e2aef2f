"""The defect catalogue and the state geography, as small static data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
ACTIONS = ("dropped", "imputed", "flagged", "quarantined", "preserved")

# Code, dataset, severity, title, how it is found, what is done.
DEFECTS: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("ST-01", "stores", "medium", "ZIP code is not five digits",
     "zip_code fails the five digit test", "pad digit-only codes and flag every suspect"),
    ("ST-02", "stores", "critical", "Store key repeats with other attributes",
     "store_id repeats while the rows differ", "elect one row by ranked criteria"),
    ("ST-03", "stores", "medium", "Region is missing",
     "region is null or blank", "fill from the state to region map and flag"),
    ("PR-01", "products", "low", "Product row repeated exactly",
     "every column is equal", "keep the first copy"),
    ("PR-02", "products", "critical", "Product key repeats with another price",
     "product_id repeats after exact copies are gone", "elect the highest price and flag"),
    ("PR-03", "products", "medium", "Category is missing",
     "category is null or blank", "use the Unknown label and flag"),
    ("PR-04", "products", "high", "Price is zero or missing",
     "unit_price is null or not above zero", "use the category median and flag"),
    ("TX-01", "transactions", "critical", "Several date formats in one column",
     "the date needs a non-ISO rung of the ladder", "parse by the first matching format"),
    ("TX-02", "transactions", "high", "Amount stored as currency text",
     "total_amount is not a bare decimal", "strip the formatting, never coerce to zero"),
    ("TX-03", "transactions", "critical", "Total is below quantity times price",
     "extended minus total exceeds the tolerance", "keep the total, expose the discount"),
    ("TX-04", "transactions", "high", "Store is unknown",
     "store_id has no cleaned store", "withhold the row"),
    ("TX-05", "transactions", "high", "Product is unknown",
     "product_id has no cleaned product", "withhold the row"),
    ("TX-06", "transactions", "medium", "Customer is missing",
     "customer_id is null or blank", "use the guest customer and keep the row"),
    ("TX-07", "transactions", "medium", "Quantity is zero",
     "quantity equals zero", "withhold the row"),
    ("TX-08", "transactions", "high", "Date lies after the reference date",
     "transaction_date is after as_of", "withhold the row"),
    ("TX-09", "transactions", "high", "Transaction row repeated exactly",
     "all eight raw columns are equal", "keep the first copy"),
    ("TX-10", "transactions", "medium", "Return with negative quantity and amount",
     "quantity and total are both below zero", "keep the row with its signs"),
)

DEFECT_CODES: tuple[str, ...] = tuple(d[0] for d in DEFECTS)

# United States census region of each state.
STATE_REGIONS: dict[str, str] = {
    **dict.fromkeys("CT ME MA NH NJ NY PA RI VT".split(), "Northeast"),
    **dict.fromkeys("IA IL IN KS MI MN MO ND NE OH SD WI".split(), "Midwest"),
    **dict.fromkeys(
        "AL AR DC DE FL GA KY LA MD MS NC OK SC TN TX VA WV".split(), "South"),
    **dict.fromkeys("AK AZ CA CO HI ID MT NM NV OR UT WA WY".split(), "West"),
}

_SPEC = T.StructType(
    [T.StructField("position", T.IntegerType(), False)]
    + [
        T.StructField(n, T.StringType(), False)
        for n in ("code", "dataset", "severity", "title", "detection", "decision")
    ]
    + [T.StructField("expected_count", T.LongType(), True)]
)


def catalog_frame(
    spark: SparkSession, expected: Mapping[str, int | None] | None = None,
    datasets: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per defect class, with the expected counts the caller states."""
    expected = expected or {}
    rows = [
        (i, *d, expected.get(d[0]))
        for i, d in enumerate(DEFECTS)
        if datasets is None or d[1] in datasets
    ]
    return spark.createDataFrame(rows, _SPEC)


def with_expected(catalog: DataFrame, expected: DataFrame) -> DataFrame:
    """Catalogue with expected counts taken from a (code, expected_count) table."""
    return catalog.drop("expected_count").join(
        F.broadcast(expected.select("code", "expected_count")), "code", "left")


def catalog_by_dataset(catalog: DataFrame) -> DataFrame:
    """Codes of each dataset in catalogue order, with their expected total."""
    return catalog.groupBy("dataset").agg(
        F.concat_ws(",", F.sort_array(F.collect_list("code"))).alias("codes"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("expected_count").alias("expected_rows"),
    )


def geography_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        sorted(STATE_REGIONS.items()), "state string, geo_region string")
