"""The star's constraints as data tests: every one counted, in one pass per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Row checks in SQL that reads the same in every dialect used here.
CHECKS: dict[str, dict[str, str]] = {
    "dim_date": {
        "quarter_range": "quarter BETWEEN 1 AND 4",
        "month_range": "month BETWEEN 1 AND 12",
        "day_range": "day_of_month BETWEEN 1 AND 31",
        "dow_range": "day_of_week BETWEEN 0 AND 6",
        "weekend_flag": "is_weekend IN (0, 1)",
        "weekend_agrees": "is_weekend = CASE WHEN day_of_week IN (0, 6) THEN 1 ELSE 0 END",
        "date_in_range": "full_date BETWEEN DATE '1800-01-01' AND DATE '2199-12-31'",
        "quarter_agrees": "quarter * 3 - month BETWEEN 0 AND 2",
        "key_agrees": "date_key = year(full_date) * 10000 + month(full_date) * 100 + day(full_date)",
        "year_month_agrees": "year_month = substr(CAST(full_date AS VARCHAR(10)), 1, 7)",
    },
    "dim_store": {
        "zip_flag": "zip_is_suspect IN (0, 1)",
        "region_flag": "region_is_imputed IN (0, 1)",
        "id_not_empty": "length(store_id) > 0",
        "zip_is_five": "length(zip_code) = 5",
        "opened_in_range": "opened_date IS NULL OR opened_date BETWEEN DATE '1800-01-01' AND DATE '2199-12-31'",
    },
    "dim_product": {
        "category_flag": "category_is_imputed IN (0, 1)",
        "price_flag": "price_is_imputed IN (0, 1)",
        "conflict_flag": "price_conflict IN (0, 1)",
        "id_not_empty": "length(product_id) > 0",
        "price_positive": "list_unit_price > 0",
    },
    "dim_customer": {
        "guest_flag": "is_guest IN (0, 1)",
        "id_not_empty": "length(customer_id) > 0",
        "guest_agrees": "is_guest = CASE WHEN customer_id = 'GUEST' THEN 1 ELSE 0 END",
    },
    "fact_sales": {
        "quantity_not_zero": "quantity <> 0",
        "price_positive": "unit_price > 0",
        "return_flag": "is_return IN (0, 1)",
        "return_sign_of_quantity":
            "(is_return = 1 AND quantity < 0) OR (is_return = 0 AND quantity > 0)",
        "return_sign_of_money":
            "(is_return = 1 AND net_amount <= 0) OR (is_return = 0 AND net_amount >= 0)",
        "extended_agrees": "abs(extended_amount - quantity * unit_price) <= 0.01",
        "discount_agrees": "abs(discount_amount - (extended_amount - net_amount)) <= 0.01",
    },
}

NOT_NULL: dict[str, tuple[str, ...]] = {
    "dim_date": ("date_key", "full_date", "year", "quarter", "month", "year_month", "month_name",
                 "day_of_month", "day_of_week", "is_weekend"),
    "dim_store": ("store_key", "store_id", "store_name", "city", "state", "zip_code",
                  "zip_is_suspect", "region", "region_is_imputed"),
    "dim_product": ("product_key", "product_id", "product_name", "category",
                    "category_is_imputed", "list_unit_price", "price_is_imputed", "price_conflict"),
    "dim_customer": ("customer_key", "customer_id", "is_guest"),
    "fact_sales": ("sales_key", "transaction_id", "date_key", "store_key", "product_key",
                   "customer_key", "quantity", "unit_price", "extended_amount",
                   "discount_amount", "net_amount", "is_return"),
}

UNIQUE: dict[str, tuple[str, ...]] = {
    "dim_date": ("date_key", "full_date"), "dim_store": ("store_key", "store_id"),
    "dim_product": ("product_key", "product_id"), "dim_customer": ("customer_key", "customer_id"),
    "fact_sales": ("sales_key", "transaction_id"),
}

FOREIGN: dict[str, str] = {
    "date_key": "dim_date", "store_key": "dim_store", "product_key": "dim_product",
    "customer_key": "dim_customer",
}


def _row_checks(table: str, df: DataFrame) -> DataFrame:
    tests = {("check", n): ~F.coalesce(F.expr(sql), F.lit(True)) for n, sql in CHECKS[table].items()}
    tests |= {("not_null", c): F.col(c).isNull() for c in NOT_NULL[table]}
    names = list(tests)
    counted = df.agg(*[F.count_if(tests[n]).alias(f"_{i}") for i, n in enumerate(names)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(kind).alias("kind"),
                 F.lit(name).alias("constraint_name"), F.col(f"_{i}").alias("violations"))
        for i, (kind, name) in enumerate(names)])))


def _unpivoted(df: DataFrame, table: str, columns: list[str], *kept: str) -> DataFrame:
    """key, value, of: one row per row and key column; a fact's foreign key bears its dimension's key name."""
    return df.select(*kept, F.lit(table).alias("of"), F.inline(F.array(*[
        F.struct(F.lit(c if c in FOREIGN else f"{table}.{c}").alias("key"), F.col(c).cast("string").alias("value")) for c in columns])))


def key_counts(star: dict[str, DataFrame], unique: bool = True) -> DataFrame:
    """key, value, fact_n, dim_n (and net of the fact's rows): how often every key value stands in the
    fact and in its dimension.

    The fact is read once for all its keys, each dimension once; values are counted before the shuffle,
    so a hot key is one row per task. ``unique`` takes the columns that must be unique in too.
    """
    own = {t: [*(UNIQUE[t] if unique else [])] for t in UNIQUE}
    for column, table in FOREIGN.items():
        own[table] = list(dict.fromkeys([*own[table], column]))
        own["fact_sales"] = list(dict.fromkeys([*own["fact_sales"], column]))
    parts = [_unpivoted(star[t], t, columns, F.col("net_amount") if t == "fact_sales" else F.lit(None).cast("decimal(18,2)").alias("net_amount"))
             for t, columns in own.items()]
    counted = reduce(DataFrame.unionByName, [p.withColumn("fact", F.lit(t == "fact_sales")) for p, t in zip(parts, own)])
    return counted.groupBy("key", "value").agg(
        F.count_if("fact").alias("fact_n"), F.count_if(~F.col("fact")).alias("dim_n"), F.sum("net_amount").alias("net"))


def _keys(star: dict[str, DataFrame]) -> DataFrame:
    """Violations of uniqueness and of all foreign keys, from one count of key values."""
    wanted = []
    for table, columns in UNIQUE.items():
        side = F.col("fact_n" if table == "fact_sales" else "dim_n")
        wanted += [(table, "unique", c, F.count_if((F.col("key") == (c if c in FOREIGN else f"{table}.{c}")) & (side > 1))) for c in columns]
    wanted += [("fact_sales", "fk", c, F.coalesce(F.sum(F.when((F.col("key") == c) & (F.col("dim_n") == 0), F.col("fact_n"))), F.lit(0))) for c in FOREIGN]
    counted = key_counts(star).agg(*[n.cast("long").alias(f"_{i}") for i, (*_, n) in enumerate(wanted)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(table).alias("table_name"), F.lit(kind).alias("kind"), F.lit(name).alias("constraint_name"), F.col(f"_{i}").alias("violations"))
        for i, (table, kind, name, _) in enumerate(wanted)])))


def constraint_suite(star: dict[str, DataFrame]) -> DataFrame:
    """(table_name, kind, constraint_name, violations) for every constraint of the star.

    Every table is read twice: for its row checks, and for its keys."""
    return reduce(DataFrame.union, [*[_row_checks(t, star[t]) for t in CHECKS], _keys(star)])
