"""The star schema: four dimensions, one fact, with keys resolved by checked lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tillproof.config import RunConfig
from tillproof.functions.dates import calendar_parts
from tillproof.functions.money import round_money, to_flag
from tillproof.operators.constraints import key_counts
from tillproof.scale import is_small, lookup, new_folder, number_rows, written
from tillproof.sources.sinks import publish, read_star, staging_folder, write_tables


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """Stop when a key repeats; counts combine before the shuffle and one key is fetched."""
    twice = df.groupBy(key).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{what}: {key} {twice[0][0]!r} repeats")
    return df


def surrogate(df: DataFrame, natural: str, key: str) -> DataFrame:
    """1..N in natural-key order. Only a table counted to be small is ranked in one task."""
    if is_small(df):
        return df.withColumn(key, F.row_number().over(W.orderBy(natural)).cast("long"))
    return number_rows(df, [natural], key)


def dim_date(sales: DataFrame, config: RunConfig) -> DataFrame:
    """Every day from the first sale to the later of the last sale and the reference date."""
    ends = sales.agg(F.min("transaction_date").alias("a"), F.max("transaction_date").alias("b"))
    first = F.coalesce("a", F.raise_error(F.lit("no transactions to build a calendar from")).cast("date"))
    days = ends.select(
        F.explode(F.sequence(first, F.greatest("b", F.lit(config.as_of)))).alias("full_date"))
    parts = calendar_parts(F.col("full_date"))
    return days.select(parts.pop("date_key").alias("date_key"), "full_date",
                       *[c.alias(name) for name, c in parts.items()])


def dim_store(stores: DataFrame) -> DataFrame:
    require_unique(stores, "store_id", "stores")
    keyed = surrogate(stores.filter("store_id is not null"), "store_id", "store_key")
    return keyed.select(
        "store_key", "store_id", "store_name", "city", "state", "zip_code",
        to_flag(F.col("zip_is_suspect")).alias("zip_is_suspect"), "region",
        to_flag(F.col("region_is_imputed")).alias("region_is_imputed"), "opened_date")


def dim_product(products: DataFrame) -> DataFrame:
    require_unique(products, "product_id", "products")
    keyed = surrogate(products.filter("product_id is not null"), "product_id", "product_key")
    return keyed.select(
        "product_key", "product_id", "product_name", "category",
        to_flag(F.col("category_is_imputed")).alias("category_is_imputed"),
        round_money(F.col("list_unit_price")).alias("list_unit_price"),
        to_flag(F.col("price_is_imputed")).alias("price_is_imputed"),
        to_flag(F.col("price_conflict")).alias("price_conflict"), "supplier_id")


def customers(sales: DataFrame, config: RunConfig) -> DataFrame:
    """Distinct customers and the guest; a customer flagged both ways stops the job."""
    guest = F.col("customer_id") == config.guest_id
    wrong = F.col("customer_id").isNull() | (F.col("low") != F.col("high")) | (F.col("low") != guest)
    seen = sales.groupBy("customer_id").agg(
        F.min("is_guest").alias("low"), F.max("is_guest").alias("high")
    ).select(F.when(wrong, F.raise_error(
        F.concat(F.lit("contradictory guest flag: "), F.coalesce("customer_id", F.lit("null")))).cast("string"))
        .otherwise(F.col("customer_id")).alias("customer_id"))
    one = sales.sparkSession.createDataFrame([(config.guest_id,)], "customer_id string")
    everyone = seen.filter(~guest).unionByName(one)
    return everyone.withColumn("is_guest", guest.cast("int"))


def dim_customer(sales: DataFrame, config: RunConfig) -> DataFrame:
    people = written(customers(sales, config), "customers")
    return surrogate(people, "customer_id", "customer_key").select(
        "customer_key", "customer_id", "is_guest")


def resolve_surrogate_key(
    fact: DataFrame, dim: DataFrame, fact_column: str, dim_column: str, key: str,
    strict: bool = True,
) -> DataFrame:
    """Swap a natural key for its surrogate. The dimension is unique on the natural key, so
    rows cannot fan out; a key that is not found stops the job when strict."""
    side = dim.select(F.col(dim_column).alias(fact_column), F.col(key).alias("_found"))
    joined = lookup(fact, side, [fact_column], stored=True)
    missing = F.raise_error(F.concat(
        F.lit(f"no {key} for "), F.coalesce(F.col(fact_column).cast("string"), F.lit("null"))))
    found = F.coalesce(F.col("_found"), missing.cast("long")) if strict else F.col("_found")
    return joined.withColumn(key, found).drop("_found")


def unresolved(fact: DataFrame, dim: DataFrame, fact_column: str, dim_column: str) -> DataFrame:
    """Fact rows whose key the dimension lacks, for the quarantine before the stop."""
    keys = dim.select(F.col(dim_column).alias("_key"))
    return fact.join(keys, fact[fact_column] == F.col("_key"), "left_anti")


def fact_rows(sales: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The fact without its row number; measures are carried, never recomputed."""
    df = resolve_surrogate_key(sales, dims["dim_date"], "transaction_date", "full_date", "date_key")
    df = resolve_surrogate_key(df, dims["dim_store"], "store_id", "store_id", "store_key")
    df = resolve_surrogate_key(df, dims["dim_product"], "product_id", "product_id", "product_key")
    df = resolve_surrogate_key(df, dims["dim_customer"], "customer_id", "customer_id", "customer_key")
    return df.select(*fact_columns())


def fact_columns() -> list[Column | str]:
    return ["transaction_id", F.col("date_key").cast("int").alias("date_key"), "store_key",
            "product_key", "customer_key", "quantity", "unit_price", "extended_amount",
            "discount_amount", F.col("total_amount").alias("net_amount"),
            to_flag(F.col("is_return")).alias("is_return")]


KEYS = {"date_key": ("dim_date", "transaction_date", "full_date"), "store_key": ("dim_store", "store_id", "store_id"),
        "product_key": ("dim_product", "product_id", "product_id"), "customer_key": ("dim_customer", "customer_id", "customer_id")}


class UnresolvedKeys(ValueError):
    """Sales whose keys a dimension lacks; they are kept as a table under ``path``."""

    def __init__(self, path: str, rows: int):
        super().__init__(f"{rows} sales rows without keys, kept at {path}")
        self.path, self.rows = path, rows


def split_rows(sales: DataFrame, dims: dict[str, DataFrame], path: str) -> None:
    """Look up all four keys and write every row once, by outcome: resolved or unresolved, the latter
    with its natural keys and the names of those that were missing."""
    df = sales
    for key, (table, column, natural) in KEYS.items():
        df = resolve_surrogate_key(df, dims[table], column, natural, key, strict=False)
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in KEYS]))
    df.withColumn("missing_keys", F.array_join(missing, ",")).select(
        *fact_columns(), *[c for _, c, _ in KEYS.values()], "missing_keys",
        F.when(F.col("missing_keys") == "", "resolved").otherwise("unresolved").alias("outcome"),
    ).write.mode("errorifexists").partitionBy("outcome").parquet(path)


def read_outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """The rows of one outcome of ``split_rows``; only that partition is read."""
    return spark.read.parquet(path).filter(F.col("outcome") == outcome).drop("outcome")


def fact_sales(sales: DataFrame, dims: dict[str, DataFrame], path: str | None = None) -> DataFrame:
    """Numbered by transaction_id order over range partitions; one row per transaction_id.

    Rows with unknown keys stop the build, after the write that keeps them under ``path``."""
    require_unique(sales, "transaction_id", "sales")
    spark = sales.sparkSession
    # Numbering reads its input twice (to sample the ranges, then to move the rows), so the
    # four lookups are done once and written first.
    path = path or new_folder(spark, "fact-rows")
    split_rows(sales, dims, path)
    lost = read_outcome(spark, path, "unresolved").count()
    if lost:
        raise UnresolvedKeys(path, lost)
    resolved = read_outcome(spark, path, "resolved").drop("missing_keys", *[c for _, c, _ in KEYS.values()])
    numbered = number_rows(resolved, ["transaction_id"], "sales_key")
    return numbered.select("sales_key", *[c for c in numbered.columns if c != "sales_key"])


def build_star(
    stores: DataFrame, products: DataFrame, sales: DataFrame, config: RunConfig, path: str,
) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Dimensions first, written side by side; the fact then looks its keys up in them.

    Returns the tables and how many rows each write saw."""
    dims, seen = write_tables({
        "dim_date": dim_date(sales, config), "dim_store": dim_store(stores),
        "dim_product": dim_product(products), "dim_customer": dim_customer(sales, config)}, path)
    # Stored in date order, so that a filter on date_key skips files and row groups by their
    # ranges. sales_key keeps the ranges even when one day holds most of the sales.
    fact = fact_sales(sales, dims, f"{path}/fact_rows")
    by_date = fact.repartitionByRange("date_key", "sales_key").sortWithinPartitions("date_key", "sales_key")
    facts, more = write_tables({"fact_sales": by_date}, path)
    return {**dims, **facts}, {**seen, **more}


def verify_star(
    star: dict[str, DataFrame], stores: DataFrame, products: DataFrame, sales: DataFrame,
) -> DataFrame:
    """One row: table sizes against what went in, broken keys and the money tie-out.

    The fact is read once: its key values, counted, also tell its rows and its money."""
    keys = key_counts(star, unique=False)
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    fed = sales.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("total_amount"), F.lit(0)).alias("money"))).scalar()
    of = lambda key, c: F.coalesce(F.sum(F.when(F.col("key") == key, F.col(c))), F.lit(0))
    return keys.agg(
        of("date_key", "fact_n").cast("long").alias("fact_rows"), of("date_key", "net").cast("decimal(28,2)").alias("fact_net"),
        *[of(f"{n}_key", "dim_n").cast("long").alias(f"{n}_rows") for n in ("store", "product", "customer", "date")],
        F.coalesce(F.sum(F.when(F.col("dim_n") == 0, F.col("fact_n"))), F.lit(0)).cast("long").alias("fk_violations"),
    ).withColumn("_fed", fed).select(
        "fact_rows", "fact_net", F.col("_fed.rows").alias("feed_rows"), "store_rows", size(stores).alias("stores_in"),
        "product_rows", size(products).alias("products_in"), "customer_rows", "date_rows", "fk_violations",
        F.round((F.col("fact_net") - F.col("_fed.money")) * 100, 0).cast("long").alias("tie_out_cents"),
    ).withColumn(
        "ok",
        (F.col("fact_rows") == F.col("feed_rows")) & (F.col("store_rows") == F.col("stores_in"))
        & (F.col("product_rows") == F.col("products_in")) & (F.col("fk_violations") == 0)
        & (F.col("tie_out_cents") == 0))


def load_star(
    stores: DataFrame, products: DataFrame, sales: DataFrame, config: RunConfig, target: str,
) -> DataFrame:
    """Build, write beside the published version, verify what was written, then point to it.

    Returns the report. Nothing is published when a row count, a key or a cent is off, or when a table
    reads back with other rows than its write saw.
    """
    spark = sales.sparkSession
    staged = staging_folder(target)
    star, seen = build_star(stores, products, sales, config, staged)
    report = verify_star(star, stores, products, sales)
    row = report.first()
    read = {"fact_sales": row["fact_rows"], **{f"dim_{n}": row[f"{n}_rows"] for n in ("store", "product", "customer", "date")}}
    if not row["ok"] or read != seen:
        raise ValueError(f"star failed verification: {row.asDict()}; rows written {seen}")
    publish(spark, staged, target)
    read_star(spark, target)
    return spark.createDataFrame([row], report.schema)
