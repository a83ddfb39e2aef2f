"""Published figures: computing them, and checking claims against them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.config import RunConfig
from tillproof.functions.money import parse_currency
from tillproof.functions.text import normalise_text

TOLERANCE = 0.005


@dataclass(frozen=True)
class FigureKeys:
    """The rows the published figures talk about."""

    conflict_product: str = "P005"
    free_product: str = "P027"
    zip_store: str = "S003"
    rate_store: str = "S006"
    first_month: str = "2026-03"
    last_month: str = "2026-06"


def _rows(df: DataFrame, named: dict[str, tuple[str, Column]]) -> DataFrame:
    """One aggregate pass turned into (figure, kind, value, text) rows."""
    wide = df.agg(*[c.cast("string").alias(n) for n, (_, c) in named.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("figure"), F.lit(kind).alias("kind"), F.col(n).alias("text"))
        for n, (kind, _) in named.items()])))


def warehouse_figures(star: dict[str, DataFrame], config: RunConfig, keys: FigureKeys) -> DataFrame:
    """(figure, kind, text) for every published scalar, in a few aggregate passes.

    The fact is joined only to the handful of dimension rows the figures name; figures about
    days come from the fact counted by day.
    """
    fact, date, store, product, customer = (star[n] for n in (
        "fact_sales", "dim_date", "dim_store", "dim_product", "dim_customer"))
    # At most two, one and one rows: these ids are unique in their dimensions.
    goods = F.broadcast(product.filter(F.col("product_id").isin(keys.conflict_product, keys.free_product))
                        .select("product_key", "product_id", "list_unit_price"))
    shop = F.broadcast(store.filter(F.col("store_id") == keys.rate_store).select("store_key", F.lit(True).alias("_shop")))
    guests = F.broadcast(customer.filter("is_guest = 1").select("customer_key", F.lit(True).alias("_guest")))
    wide = fact.join(goods, "product_key", "left").join(shop, "store_key", "left").join(guests, "customer_key", "left")
    conflict = F.col("product_id") == keys.conflict_product
    free = F.col("product_id") == keys.free_product
    at_store, guest = F.col("_shop").isNotNull(), F.col("_guest").isNotNull()
    money = lambda c: F.round(c, 2).cast("decimal(28,2)")
    pct = lambda a, b: (F.round(a.cast("double") * 10000 / b.cast("double")) / 100).cast("decimal(18,2)")
    units = lambda cond: F.sum(F.when(cond, F.abs("quantity")))
    back = F.col("is_return") == 1
    sold = _rows(wide, {
        "conflict_fact_price": ("money", F.max(F.when(conflict, F.col("unit_price")))),
        "conflict_fact_rows": ("int", F.count_if(conflict)),
        "conflict_price_delta": ("money", F.max(F.when(conflict, F.col("list_unit_price") - F.col("unit_price")))),
        "free_fact_price": ("money", F.max(F.when(free, F.col("unit_price")))),
        "guest_fact_rows": ("int", F.count_if(guest)),
        "guest_revenue": ("money", money(F.sum(F.when(guest, F.col("net_amount"))))),
        "return_rows": ("int", F.count_if(back)),
        "return_units": ("int", -F.sum(F.when(back, F.col("quantity")))),
        "discount_rows": ("int", F.count_if(F.col("discount_amount") > F.lit(config.price_tolerance).cast("decimal(9,2)"))),
        "discount_share_pct": ("percent", pct(F.sum("discount_amount"), F.sum("net_amount"))),
        "store_contract_rate_pct": ("percent", pct(units(at_store & back), units(at_store & ~back))),
    })
    by_day = fact.groupBy("date_key").agg(F.count(F.lit(1)).alias("_n")).join(date, "date_key")
    in_window = F.col("full_date").between(config.window_start, config.as_of)
    days = _rows(by_day, {
        "window_fact_rows": ("int", F.coalesce(F.sum(F.when(in_window, F.col("_n"))), F.lit(0))),
        "days_first_month": ("int", F.count_if(F.col("year_month") == keys.first_month)),
        "days_last_month": ("int", F.count_if(F.col("year_month") == keys.last_month)),
        "first_txn_date": ("text", F.min("full_date")),
        "last_txn_date": ("text", F.max("full_date")),
    })
    listed = _rows(product, {
        "conflict_dim_price": ("money", F.max(F.when(conflict, F.col("list_unit_price")))),
        "free_dim_price": ("money", F.max(F.when(free, F.col("list_unit_price")))),
        "products_category_imputed": ("int", F.sum("category_is_imputed")),
    })
    named = F.col("store_id") == keys.zip_store
    places = _rows(store, {
        "store_zip": ("text", F.max(F.when(named, F.col("zip_code")))),
        "store_zip_suspect": ("int", F.max(F.when(named, F.col("zip_is_suspect")))),
        "stores_region_imputed": ("int", F.sum("region_is_imputed")),
        "distinct_regions": ("int", F.count_distinct("region")),
    })
    people = _rows(customer, {"real_customers": ("int", F.count_if(F.col("is_guest") == 0))})
    return sold.unionByName(days).unionByName(listed).unionByName(places).unionByName(people)


def claimed_number(c: Column) -> Column:
    """The number a rendered figure states; null when it is none."""
    text = F.translate(normalise_text(c), "−–", "--")
    credit = text.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(text, r"^\(|\)$|[$,%+\s\x{00A0}]", "")
    value = F.when(bare.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), bare.try_cast("double"))
    return F.when(credit, -value).otherwise(value)


def check_published_figures(claims: DataFrame, figures: DataFrame) -> DataFrame:
    """Each claim against its figure: ok, stale, unknown (no such figure), or uncited."""
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    left = claims.select("figure", F.col("kind").alias("claim_kind"), "claimed_text", F.lit(1).alias("_c"))
    right = figures.select("figure", "kind", "text", F.lit(1).alias("_f"))
    kind = F.coalesce("claim_kind", "kind")
    claimed, actual = claimed_number(F.col("claimed_text")), F.col("text").try_cast("double")
    gap = F.abs(claimed - actual)
    same = F.when(kind == "text", fold(F.col("claimed_text")) == fold(F.col("text"))).when(
        kind == "int", gap < 1e-9).otherwise(gap <= TOLERANCE + 1e-9)
    return left.join(right, "figure", "full").select(
        "figure", kind.alias("kind"), "claimed_text", F.col("text").alias("actual_text"),
        F.when(F.col("_f").isNull(), "unknown").when(F.col("_c").isNull(), "uncited")
        .when(F.coalesce(same, F.lit(False)), "ok").otherwise("stale").alias("verdict"))


def lineage_summary(lineage: DataFrame) -> DataFrame:
    """Counts by outcome and by reason, and the total, in one pass."""
    counts = lineage.rollup("disposition", "reason_code").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.grouping_id("disposition", "reason_code").alias("_level"))
    by_reason = counts.filter("_level = 0 and reason_code is not null").groupBy(
        F.concat(F.lit("reason."), "reason_code").alias("figure")).agg(F.sum("source_rows").alias("source_rows"))
    rest = counts.filter("_level > 0").select(
        F.when(F.col("_level") == 3, "total").otherwise(F.col("disposition")).alias("figure"), "source_rows")
    return by_reason.unionByName(rest)


def independent_tieout(
    star: dict[str, DataFrame], flagged: DataFrame, ledger: DataFrame, catalog: DataFrame,
    raw: DataFrame, sales: DataFrame,
) -> DataFrame:
    """(check_name, expected, actual, ok): the same facts by separate routes.

    The source's rows and money are counted from the ``raw`` feed again, and the net from the
    cleaned ``sales``, so a row lost or changed on the way to the working table shows.
    """
    fact = star["fact_sales"]
    money = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(28,2)")
    kept = F.col("disposition") == "kept"
    a = fact.agg(
        money("net_amount").alias("net"),
        money(F.col("extended_amount") - F.col("discount_amount")).alias("lines"),
        money(F.when(F.col("is_return") == 0, F.col("extended_amount"))).alias("gross"),
        money(F.when(F.col("is_return") == 0, F.col("discount_amount"))).alias("discount"),
        money(F.when(F.col("is_return") == 1, F.col("net_amount"))).alias("refunds"),
        F.count(F.lit(1)).alias("fact_rows"))
    b = flagged.agg(
        money(F.when(kept, F.col("parsed_total_amount"))).alias("kept_money"),
        money(F.when(~kept, F.col("parsed_total_amount"))).alias("held_money"),
        F.count_if(kept).alias("kept_rows"),
        F.count_if(~kept).alias("held_rows"))
    c = raw.agg(money(parse_currency(F.col("total_amount"))).alias("all_money"), F.count(F.lit(1)).alias("all_rows"))
    d = sales.agg(money("total_amount").alias("clean_money"), F.count(F.lit(1)).alias("clean_rows"))
    # One row each.
    one = reduce(lambda x, y: x.join(y, "_one"), [df.withColumn("_one", F.lit(1)) for df in (a, b, c, d)])
    dec = lambda c: c.cast("decimal(28,2)")
    checks = [
        ("net_fact_vs_ledger", F.col("kept_money"), F.col("net")),
        ("net_fact_vs_lines", F.col("lines"), F.col("net")),
        ("net_vs_source_less_held", F.col("all_money") - F.col("held_money"), F.col("net")),
        ("gross_less_discount_plus_returns", F.col("gross") - F.col("discount") + F.col("refunds"), F.col("net")),
        ("net_fact_vs_clean", F.col("clean_money"), F.col("net")),
        ("fact_rows_vs_kept", F.col("kept_rows"), F.col("fact_rows")),
        ("fact_rows_vs_clean", F.col("clean_rows"), F.col("fact_rows")),
        ("row_budget", F.col("all_rows"), F.col("kept_rows") + F.col("held_rows")),
    ]
    totals = one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), dec(e).alias("expected"), dec(v).alias("actual"))
        for n, e, v in checks])))
    counts = catalog.filter("expected_count is not null").join(F.broadcast(ledger), "code", "left").select(
        F.concat(F.lit("count."), "code").alias("check_name"), dec(F.col("expected_count")).alias("expected"),
        dec(F.coalesce("detected_count", F.lit(0))).alias("actual"))
    return totals.unionByName(counts).withColumn("ok", F.col("expected") == F.col("actual"))
