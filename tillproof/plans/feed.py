"""The raw retail feed, derived from the TPC-H style tables by fixed arithmetic rules.

Suppliers act as stores, parts as products and line items as transactions. Every defect is
planted by a residue of a key, so the same feed can be written in plain SQL. Nothing here
sorts or shuffles beyond the two key joins of the transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillproof.scale import spread
from tillproof.schemas import MONEY
from tillproof.sources.files import parquet_with_row_place

# A state for each of the 25 nations, in nation order.
NATION_STATES = (
    "NY", "PA", "NJ", "OH", "IL", "MI", "TX", "FL", "GA", "CA", "WA", "OR", "AZ", "CO", "NV",
    "MA", "CT", "WI", "MN", "VA", "NC", "TN", "UT", "PR", "GU",
)
# The region label each state carries in the feed where it carries one.
STATE_LABELS = (
    "Northeast", "Northeast", "Northeast", "Midwest", "Midwest", "Midwest", "South", "South",
    "South", "West", "West", "West", "West", "West", "West", "Northeast", "Northeast",
    "Midwest", "Midwest", "South", "South", "South", "West", None, None,
)


def _mod(c: str, n: int, r: int) -> Column:
    return F.col(c) % n == r


def _pick(values: tuple[str | None, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stores: short ZIPs, second spellings, missing regions."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        "s_suppkey", "s_name", "s_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    key = F.col("s_suppkey")
    copies = F.when(_mod("s_suppkey", 20, 6), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumn(
        "copy", F.explode(copies))
    second = F.col("copy") == 1
    year = F.lit(1990) + key % 30 - F.when(second & _mod("s_suppkey", 3, 0), 1).otherwise(0)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return rows.select(
        (key * 2 + F.col("copy")).alias("source_row"),
        F.concat(F.lit("S"), key.cast("string")).alias("store_id"),
        F.when(second, F.concat(F.lit("A "), F.col("s_name"))).otherwise(F.col("s_name")).alias("store_name"),
        F.when(~(second & _mod("s_suppkey", 40, 6)), F.col("n_name")).alias("city"),
        _pick(NATION_STATES, F.col("s_nationkey")).alias("state"),
        F.when(_mod("s_suppkey", 10, 3), (1000 + key * 7 % 8999).cast("string"))
        .otherwise((10000 + key * 37 % 89999).cast("string")).alias("zip_code"),
        F.when((key % 7 != 2) & (F.col("s_nationkey") % 12 != 5),
               _pick(STATE_LABELS, F.col("s_nationkey"))).alias("region"),
        F.concat_ws("-", year.cast("string"), two(key % 12 + 1), two(key % 28 + 1)).alias("opened_date"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: exact copies, a second price, missing categories, zero prices."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    key = F.col("p_partkey")
    planted = (F.col("copy") == 0) | ((F.col("copy") == 1) & _mod("p_partkey", 60, 5)) | (
        (F.col("copy") == 2) & (_mod("p_partkey", 50, 12) | _mod("p_partkey", 120, 65)))
    price = F.col("p_retailprice").cast(MONEY)
    price = F.when(_mod("p_partkey", 40, 27), F.lit(0).cast(MONEY)).when(
        F.col("copy") == 1, (price + F.lit(8.50).cast(MONEY)).cast(MONEY)).otherwise(price)
    text = price.cast("string")
    return p.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter(planted).select(
        (key * 4 + F.col("copy")).alias("source_row"),
        F.concat(F.lit("P"), key.cast("string")).alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.when(~_mod("p_partkey", 6, 3), F.col("p_type")).alias("category"),
        F.when(_mod("p_partkey", 9, 4), F.concat(F.lit("$"), text)).otherwise(text).alias("unit_price"),
        F.col("p_brand").alias("supplier_id"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions, with all ten transaction defects."""
    lines = spread(parquet_with_row_place(spark, f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag", F.to_date("l_shipdate").alias("ship"), "pos"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.col("p_retailprice").cast(MONEY).alias("price"))
    sold = F.col("l_quantity").cast("int")
    quantity = F.when(_mod("l_orderkey", 97, 5), 0).when(
        F.col("l_returnflag") == "R", -sold).otherwise(sold)
    key, ship = F.col("l_orderkey"), F.col("ship").cast("string")
    year, month, day = (F.substring(ship, a, n) for a, n in ((1, 4), (6, 2), (9, 2)))
    total = F.round(
        F.col("units") * F.col("price") * (1 - F.col("l_discount").cast("decimal(4,2)")), 2
    ).cast(MONEY).cast("string")
    copies = F.when(_mod("l_orderkey", 33, 4), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn("units", quantity)
        .withColumn("total", total)
        .withColumn("copy", F.explode(copies))
        .select(
            (F.col("pos") * 2 + F.col("copy")).alias("source_row"),
            F.concat(F.lit("T"), key, F.lit("-"), F.col("l_linenumber"), F.lit("-"), F.col("pos")).alias("transaction_id"),
            F.when(_mod("l_orderkey", 25, 0), F.concat_ws("/", month, day, year))
            .when(_mod("l_orderkey", 25, 1), F.concat_ws("-", day, month, year))
            .otherwise(ship).alias("transaction_date"),
            F.concat(F.when(_mod("l_orderkey", 61, 7), F.lit("S9999")).otherwise(F.lit("S")),
                     F.col("l_suppkey")).alias("store_id"),
            F.concat(F.when(_mod("l_orderkey", 67, 9), F.lit("P9999999")).otherwise(F.lit("P")),
                     F.col("l_partkey")).alias("product_id"),
            F.when(F.col("o_custkey") % 12 != 0, F.concat(F.lit("C"), F.col("o_custkey"))).alias("customer_id"),
            F.col("units").cast("string").alias("quantity"),
            F.col("price").cast("string").alias("unit_price"),
            F.when(_mod("l_orderkey", 211, 17), F.lit("n/a"))
            .when(_mod("l_orderkey", 20, 2), F.concat(F.lit("$"), F.col("total")))
            .otherwise(F.col("total")).alias("total_amount"),
        )
    )


def expected_counts(spark: SparkSession, sf_dir: str, config) -> DataFrame:
    """How many source rows of each defect the rules above plant, counted from the base keys
    alone, without the detectors."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_returnflag", "l_discount", "l_shipdate")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    key = F.col("l_orderkey")
    n = F.when(key % 33 == 4, 2).otherwise(1)
    unread, empty = key % 211 == 17, key % 97 == 5
    measured = ~unread & ~empty
    sums = {
        "TX-01": key % 25 < 2,
        "TX-02": unread | (key % 20 == 2),
        "TX-03": measured & (F.col("l_discount") > 0),
        "TX-04": key % 61 == 7,
        "TX-05": key % 67 == 9,
        "TX-06": F.col("o_custkey") % 12 == 0,
        "TX-07": empty,
        "TX-08": F.to_date("l_shipdate") > F.lit(config.as_of),
        "TX-10": measured & (F.col("l_returnflag") == "R"),
    }
    sold = lines.join(orders, key == F.col("o_orderkey")).agg(
        *[F.sum(F.when(c, n).otherwise(0)).alias(code) for code, c in sums.items()],
        F.count_if(key % 33 == 4).alias("TX-09"))
    s = F.col("s_suppkey")
    shops = spark.read.parquet(f"{sf_dir}/supplier.parquet").agg(
        F.count_if(s % 10 == 3).alias("ST-01"), F.count_if(s % 20 == 6).alias("ST-02"),
        F.count_if((s % 7 == 2) | (F.col("s_nationkey") % 12 == 5)
                   | F.col("s_nationkey").isin(23, 24)).alias("ST-03"))
    p = F.col("p_partkey")
    goods = spark.read.parquet(f"{sf_dir}/part.parquet").agg(
        F.count_if((p % 50 == 12) | (p % 120 == 65)).alias("PR-01"), F.count_if(p % 60 == 5).alias("PR-02"),
        F.count_if(p % 6 == 3).alias("PR-03"), F.count_if(p % 40 == 27).alias("PR-04"))

    def tall(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").cast("long").alias("expected_count"))
            for c in df.columns])))

    return tall(sold).unionByName(tall(shops)).unionByName(tall(goods))
