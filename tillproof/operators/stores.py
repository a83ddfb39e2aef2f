"""Store cleaning: ZIP padding, survivorship of repeated keys, region fill."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.catalog import geography_frame
from tillproof.config import RunConfig
from tillproof.functions.codes import zip_is_suspect, zip_pad_guarded
from tillproof.functions.dates import parsed_date
from tillproof.functions.text import normalise_frame
from tillproof.scale import lookup
from tillproof.schemas import RAW_COLUMNS, STORES_CLEAN, require_columns

COLUMNS = RAW_COLUMNS["stores"]
# Reason code of rows that have no key; it is not a defect class of the catalogue.
NO_KEY = "NO-KEY"


@dataclass(frozen=True)
class Criterion:
    """One ranking rule: the smaller value wins and null loses."""

    name: str
    value: Column


def null_count(columns: list[str] | tuple[str, ...]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def store_criteria() -> list[Criterion]:
    return [
        Criterion("fewest_nulls", null_count(COLUMNS)),
        Criterion("earliest_opened_date", parsed_date(F.col("opened_date"))),
        Criterion("first_store_name", F.col("store_name")),
    ]


def flag_zip(df: DataFrame) -> DataFrame:
    """ST-01: flag every suspect ZIP and pad the digit-only ones."""
    return df.withColumns({
        "zip_is_suspect": zip_is_suspect(F.col("zip_code")),
        "zip_code": zip_pad_guarded(F.col("zip_code")),
    })


def elect(df: DataFrame, key: str, criteria: list[Criterion]) -> DataFrame:
    """One row per key: the winner, group size and the criterion that decided. Rows without a
    key stand for different things, so they take no part.

    A grouped minimum over (criteria, source_row, row) combines before the shuffle, so a
    key of any size ends as one small record per task.
    """
    staged = df.filter(F.col(key).isNotNull()).withColumns({f"_c{i}": rule.value for i, rule in enumerate(criteria)})
    ranks, differs = [], []
    for i, rule in enumerate(criteria):
        c = F.col(f"_c{i}")
        ranks += [c.isNull().alias(f"n{i}"), c.alias(f"v{i}")]
        held = F.count(c)
        differs.append(
            (rule.name, ((held > 0) & (held < F.count(F.lit(1))))
             | F.coalesce(F.min(c) != F.max(c), F.lit(False))))
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    groups = staged.groupBy(key).agg(
        F.min(F.struct(*ranks, F.col("source_row").alias("order"), row)).alias("_best"),
        F.count(F.lit(1)).alias("group_rows"),
        *[flag.alias(f"_differs_{name}") for name, flag in differs],
    )
    decided = F.coalesce(
        *[F.when(F.col(f"_differs_{name}"), F.lit(name)) for name, _ in differs],
        F.lit("row_order_fallback"))
    return groups.select(
        key, "group_rows", F.when(F.col("group_rows") > 1, decided).alias("decided_by"),
        F.col("_best.row").alias("winner"))


def keyless_rows(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """Rows that no key names, held back with a reason; they are in no table and no election."""
    return df.filter(F.col(key).isNull()).select(
        F.lit(dataset).alias("dataset"), F.lit(NO_KEY).alias("reason_code"), F.lit("row without a key").alias("reason_detail"),
        "source_row", F.lit(None).cast("string").alias("row_key"), F.lit("quarantined").alias("disposition"))


def dimension_budget(source: DataFrame, clean: DataFrame, defects: DataFrame, held: DataFrame, dataset: str) -> DataFrame:
    """One row: every source row of a dimension is kept, dropped or held back, or the job stops.

    ``defects`` may name a row more than once; ``held`` are its keyless rows.
    """
    dropped = defects.filter((F.col("dataset") == dataset) & (F.col("disposition") == "dropped")).select("source_row").distinct()
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in (
        ("source_rows", source), ("kept", clean), ("dropped", dropped), ("quarantined", held))]
    row = reduce(DataFrame.unionByName, parts).groupBy().pivot("part", ["source_rows", "kept", "dropped", "quarantined"]).agg(F.first("n"))
    total = F.col("kept") + F.col("dropped") + F.col("quarantined")
    return row.select(F.lit(dataset).alias("dataset"), "*", F.when(total == F.col("source_rows"), True).otherwise(
        F.raise_error(F.lit(f"row budget of {dataset} does not balance")).cast("boolean")).alias("balanced"))


def survivorship_ranked(df: DataFrame, key: str, criteria: list[Criterion]) -> DataFrame:
    """The elected row of every key."""
    return elect(df, key, criteria).select("winner.*")


def survivorship_evidence(df: DataFrame, key: str, criteria: list[Criterion]) -> DataFrame:
    """Every row of every repeated key with ELECTED or REJECTED and the deciding criterion."""
    repeated = elect(df, key, criteria).filter("group_rows > 1").select(
        key, "group_rows", "decided_by", F.col("winner.source_row").alias("_elected_row"))
    return lookup(df, repeated, [key], "inner").withColumn(
        "verdict",
        F.when(F.col("source_row") == F.col("_elected_row"), "ELECTED").otherwise("REJECTED"),
    ).drop("_elected_row")


def build_value_map(df: DataFrame, key: str, value: str, config: RunConfig) -> DataFrame:
    """Key to label: observed pairs first, static geography only for labels the column
    already uses, else Unknown. A key with two labels stops the job."""
    spark = df.sparkSession
    pairs = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"))
    vocabulary = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_word")).distinct()
    broken = F.raise_error(F.concat(F.lit("two labels for "), F.col(key))).cast("string")
    observed = F.when(F.col("_low") != F.col("_high"), broken).otherwise(F.col("_low"))
    geography = geography_frame(spark).withColumnRenamed("state", key)
    allowed = geography.join(vocabulary, F.col("geo_region") == F.col("_word"), "left_semi")
    return pairs.join(F.broadcast(allowed), key, "left").select(
        key,
        F.coalesce(observed, F.col("geo_region"), F.lit(config.unknown_label)).alias("mapped_value"),
        F.when(F.col("_low").isNotNull(), "observed")
        .when(F.col("geo_region").isNotNull(), "geography").otherwise("unknown").alias("map_source"),
    )


def impute_region(df: DataFrame, value_map: DataFrame, config: RunConfig) -> DataFrame:
    """ST-03: fill missing regions from the map and flag them."""
    return lookup(
        df, value_map.select("state", "mapped_value"), ["state"], "left"
    ).withColumns({
        "region_is_imputed": F.col("region").isNull(),
        "region": F.coalesce("region", "mapped_value", F.lit(config.unknown_label)),
    }).drop("mapped_value")


def prepared_stores(raw: DataFrame) -> DataFrame:
    require_columns(raw, COLUMNS, "stores")
    return flag_zip(normalise_frame(raw, COLUMNS))


def clean_stores(raw: DataFrame, config: RunConfig) -> DataFrame:
    """Text, ZIP, survivorship, region, then the typed columns."""
    survivors = survivorship_ranked(prepared_stores(raw), "store_id", store_criteria())
    filled = impute_region(survivors, build_value_map(survivors, "state", "region", config), config)
    return filled.withColumn("opened_date", parsed_date(F.col("opened_date"))).select(*STORES_CLEAN)


def store_defects(raw: DataFrame) -> DataFrame:
    """(code, dataset, source_row, key, disposition) for every source row a store rule touched."""
    rows = prepared_stores(raw)
    survivors = survivorship_ranked(rows, "store_id", store_criteria())
    base = [F.col("source_row"), F.col("store_id").alias("row_key")]
    rows = rows.filter("store_id is not null")
    suspects = rows.filter("zip_is_suspect").select(
        F.lit("ST-01").alias("code"), *base, F.lit("evidence").alias("disposition"))
    evidence = survivorship_evidence(rows, "store_id", store_criteria()).select(
        F.lit("ST-02").alias("code"), *base,
        F.when(F.col("verdict") == "REJECTED", "dropped").otherwise("evidence").alias("disposition"))
    blank = survivors.filter("region is null").select(
        F.lit("ST-03").alias("code"), *base, F.lit("evidence").alias("disposition"))
    evidence = evidence.withColumn("counted", F.col("disposition") == "dropped")
    suspects, blank = (d.withColumn("counted", F.lit(True)) for d in (suspects, blank))
    return suspects.unionByName(evidence).unionByName(blank).withColumn("dataset", F.lit("stores"))
