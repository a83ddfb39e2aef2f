"""Registered queries for the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillproof.config import FEED_CONFIG as CONFIG
from tillproof.functions.text import normalise_frame
from tillproof.operators import products as P, stores as S, transactions as T
from tillproof.registry.base import Query, on_feed
from tillproof.registry.oracle import over
from tillproof.schemas import PRODUCTS_CLEAN, RAW_COLUMNS, STORES_CLEAN, TRANSACTIONS_CLEAN


def _dbl(df, *names):
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def _parsed(w):
    return T.parse_measures(w.raw["transactions"], CONFIG)


def _tidy_products(w):
    return normalise_frame(w.raw["products"], RAW_COLUMNS["products"])


def _line_ids(w):
    """Transactions under the id of their order line alone, which other lines share."""
    return w.raw["transactions"].withColumn(
        "line_id", F.substring_index("transaction_id", "-", 2))


def _priced(w):
    return P.resolve_duplicate_keys(_tidy_products(w)).withColumn(
        "price", P.parse_price(F.col("unit_price"), F.col("product_id")))


MEASURES = ("parsed_unit_price", "parsed_total_amount")

QUERIES = [
    Query("drop_exact_duplicates", on_feed(lambda w: P.drop_exact_duplicates(_tidy_products(w)).select(
        "source_row", *RAW_COLUMNS["products"])),
          over("SELECT source_row, product_id, product_name, category, unit_price, supplier_id FROM versions", "settled_products")),
    Query("exact_copies", on_feed(lambda w: P.exact_copies(_tidy_products(w)).select("source_row", "product_id")),
          over("SELECT source_row, product_id FROM marked_products WHERE copy_no > 1", "settled_products")),
    Query("flag_exact_duplicates", on_feed(lambda w: T.flag_exact_duplicates(w.raw_rows).select(
        "source_row", "transaction_id", "is_copy")),
          over("SELECT source_row, transaction_id, is_copy FROM parsed", "flagged")),
    Query("id_collisions", on_feed(lambda w: T.id_collisions(_line_ids(w), "line_id")),
          over("""SELECT line_id, count(*) AS versions, CAST(sum(copies) AS BIGINT) AS source_rows FROM (
  SELECT regexp_extract(transaction_id, '^[^-]+-[^-]+') AS line_id, transaction_id, count(*) AS copies
  FROM raw_transactions GROUP BY ALL) GROUP BY line_id HAVING count(*) > 1""", "raw_transactions")),
    Query("survivorship_ranked", on_feed(lambda w: S.survivorship_evidence(
        S.prepared_stores(w.raw["stores"]), "store_id", S.store_criteria()).select(
        "store_id", "source_row", "store_name", "city", "opened_date", "group_rows", "decided_by", "verdict")),
          over("""SELECT store_id, source_row, store_name, city, opened_date, group_rows, decided_by,
  CASE WHEN place = 1 THEN 'ELECTED' ELSE 'REJECTED' END AS verdict FROM ranked_stores WHERE group_rows > 1""", "ranked_stores")),
    Query("resolve_conflicts_by_policy", on_feed(lambda w: P.conflict_evidence(P.drop_exact_duplicates(_tidy_products(w))).select(
        "product_id", "source_row", "unit_price", "group_rows", "conflicting_columns",
        F.col("price_delta").cast("double").alias("price_delta"), "is_elected")),
          over("""SELECT product_id, source_row, unit_price, group_rows, 'unit_price' AS conflicting_columns,
  CAST(spread AS DOUBLE) AS price_delta, place = 1 AS is_elected FROM versions WHERE group_rows > 1""", "settled_products")),
    Query("resolve_duplicate_keys", on_feed(lambda w: P.resolve_duplicate_keys(_tidy_products(w)).select(
        "product_id", "product_name", "category", "unit_price", "supplier_id", "price_conflict", "group_rows")),
          over("SELECT product_id, product_name, category, unit_price, supplier_id, spread > 0 AS price_conflict, group_rows FROM settled_products", "settled_products")),
    Query("build_value_map", on_feed(lambda w: S.build_value_map(
        S.survivorship_ranked(S.prepared_stores(w.raw["stores"]), "store_id", S.store_criteria()), "state", "region", CONFIG)),
          over("SELECT state, mapped_value, map_source FROM state_map", "state_map")),
    Query("impute_region", on_feed(lambda w: w.stores.select("store_id", "region", "region_is_imputed")),
          over("SELECT store_id, region, region_is_imputed FROM stores_clean", "stores_clean")),
    Query("impute_literal", on_feed(lambda w: P.impute_literal(_tidy_products(w)).select("source_row", "category", "category_is_imputed")),
          over("SELECT source_row, coalesce(category, 'Unknown') AS category, category IS NULL AS category_is_imputed FROM raw_products", "raw_products")),
    Query("impute_group_median", on_feed(lambda w: P.impute_group_median(_priced(w)).select(
        "product_id", "category", F.col("price").cast("double").alias("price"), "price_is_imputed")),
          over("""SELECT p.product_id, s.category, CAST(p.list_unit_price AS DOUBLE) AS price, p.price_is_imputed
FROM products_clean p JOIN settled_products s ON p.product_id = s.product_id""", "products_clean")),
    Query("impute_sentinel", on_feed(lambda w: T.guest_report(T.impute_sentinel(_parsed(w), CONFIG))),
          over("SELECT is_guest, count(*) AS source_rows, CAST(sum(total) AS DOUBLE) AS revenue, count(DISTINCT customer) AS customers FROM flagged GROUP BY is_guest", "flagged")),
    Query("flag_returns", on_feed(lambda w: T.flag_returns(_parsed(w)).select("source_row", "is_return", "sign_disagrees")),
          over("SELECT source_row, is_return, coalesce(units * total < 0, FALSE) AS sign_disagrees FROM flagged", "flagged")),
    Query("flag_zero_quantity", on_feed(lambda w: T.flag_zero_quantity(_parsed(w)).select("source_row", "zero_quantity", "zero_with_money")),
          over("SELECT source_row, zero_quantity, coalesce(zero_quantity AND total <> 0, FALSE) AS zero_with_money FROM flagged", "flagged")),
    Query("flag_future", on_feed(lambda w: T.future_report(T.flag_future(_parsed(w), CONFIG))),
          over(f"SELECT CAST(datediff('day', DATE '{CONFIG.as_of}', day) AS INTEGER) AS days_ahead, count(*) AS source_rows, CAST(sum(total) AS DOUBLE) AS withheld FROM flagged WHERE is_future GROUP BY 1", "flagged")),
    Query("flag_orphans", on_feed(lambda w: T.orphan_report(T.flag_orphans(T.flag_orphans(
        _parsed(w), w.stores, "store_id", "store_id", "orphan_store"), w.products, "product_id", "product_id", "orphan_product"))),
          over("""SELECT orphan_store, orphan_product, f.store_id, count(*) AS source_rows, CAST(sum(total) AS DOUBLE) AS withheld FROM (
  SELECT r.store_id, r.total, s.store_id IS NULL AS orphan_store, p.product_id IS NULL AS orphan_product FROM parsed r
  LEFT JOIN stores_clean s ON r.store_id = s.store_id LEFT JOIN products_clean p ON r.product_id = p.product_id) f
WHERE orphan_store OR orphan_product GROUP BY ALL""", "flagged", "stores_clean", "products_clean")),
    Query("reconcile_totals", on_feed(lambda w: T.discount_report(T.reconcile_totals(_parsed(w), CONFIG))),
          over("""SELECT count(*) FILTER (WHERE has_discount) AS discounted_rows, CAST(sum(discount) FILTER (WHERE has_discount) AS DOUBLE) AS discount_total,
  min(round(CAST(discount AS DOUBLE) / CAST(extended AS DOUBLE) * 100)) FILTER (WHERE has_discount) / 100 AS lowest_pct,
  max(round(CAST(discount AS DOUBLE) / CAST(extended AS DOUBLE) * 100)) FILTER (WHERE has_discount) / 100 AS highest_pct,
  CAST(sum(extended - total) FILTER (WHERE has_discount) AS DOUBLE) AS overstatement_avoided FROM flagged""", "flagged")),
    Query("assign_disposition", on_feed(lambda w: w.lineage.withColumn("total_amount_as_reported", F.col("total_amount_as_reported").cast("double")).drop("reason_detail")),
          over("SELECT source_row, transaction_id, disposition, reason_code, CAST(total AS DOUBLE) AS total_amount_as_reported FROM flagged", "flagged")),
    Query("row_budget", on_feed(lambda w: _dbl(T.row_budget(w.flagged), "reported")),
          over("SELECT disposition, coalesce(reason_code, '-') AS reason_code, count(*) AS source_rows, CAST(coalesce(sum(total), 0) AS DOUBLE) AS reported FROM flagged GROUP BY 1, 2", "flagged")),
    Query("budget_check", on_feed(lambda w: T.check_budget(w.flagged)),
          over("""SELECT count(*) AS source_rows, count(*) FILTER (WHERE disposition = 'kept') AS kept, count(*) FILTER (WHERE disposition = 'dropped') AS dropped,
  count(*) FILTER (WHERE disposition = 'quarantined') AS quarantined,
  count(*) FILTER (WHERE needed_non_iso::INT + currency_formatted::INT + has_discount::INT + orphan_store::INT + orphan_product::INT
    + is_guest::INT + zero_quantity::INT + is_future::INT + is_copy::INT + is_return::INT > 1) AS rows_with_several_codes, TRUE AS balanced FROM flagged""", "flagged")),
    Query("quarantine_view", on_feed(lambda w: T.quarantine_view(w.flagged).select(
        "source_row", "transaction_id", "transaction_date", "total_amount", "parsed_date", "parsed_quantity",
        F.col("parsed_total_amount").cast("double").alias("parsed_total_amount"), "reason_code", "disposition")),
          over("""SELECT f.source_row, f.transaction_id, f.transaction_date, f.total_amount, f.day AS parsed_date, f.units AS parsed_quantity,
  CAST(f.total AS DOUBLE) AS parsed_total_amount, s.reason_code, s.disposition
FROM slices s JOIN flagged f ON s.source_row = f.source_row WHERE s.dataset = 'transactions'""", "slices")),
    Query("parse_measures", on_feed(lambda w: _dbl(_parsed(w), *MEASURES).select(
        "source_row", "parsed_date", "date_format", "needed_non_iso", "date_is_ambiguous", "parsed_quantity", *MEASURES,
        "currency_formatted", "amount_unparsed")),
          over("""SELECT source_row, day AS parsed_date, fmt AS date_format, needed_non_iso, date_is_ambiguous, units AS parsed_quantity,
  CAST(price AS DOUBLE) AS parsed_unit_price, CAST(total AS DOUBLE) AS parsed_total_amount, currency_formatted, amount_unparsed FROM flagged""", "flagged")),
    Query("measure_report", on_feed(lambda w: T.measure_report(_parsed(w))),
          over("""SELECT coalesce(fmt, 'unread') AS date_format, count(*) AS source_rows, count(*) FILTER (WHERE currency_formatted) AS currency_formatted_rows,
  count(*) FILTER (WHERE amount_unparsed) AS unparsed_rows, CAST(sum(total) AS DOUBLE) AS carried_revenue FROM flagged GROUP BY 1""", "flagged")),
    Query("clean_stores", on_feed(lambda w: w.stores),
          over(f"SELECT {', '.join(STORES_CLEAN)} FROM stores_clean", "stores_clean")),
    Query("clean_products", on_feed(lambda w: _dbl(w.products, "list_unit_price")),
          over(f"SELECT {', '.join(PRODUCTS_CLEAN)} FROM products_clean".replace("list_unit_price", "CAST(list_unit_price AS DOUBLE) AS list_unit_price"), "products_clean")),
    Query("clean_transactions", on_feed(lambda w: _dbl(w.sales, "unit_price", "extended_amount", "total_amount", "discount_amount")),
          over("SELECT " + ", ".join(
              f"CAST({c} AS DOUBLE) AS {c}" if c in ("unit_price", "extended_amount", "total_amount", "discount_amount") else c
              for c in TRANSACTIONS_CLEAN) + " FROM sales", "sales")),
]
