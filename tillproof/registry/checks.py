"""Registered queries for figures, tie-outs, cell comparison and what-if."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tillproof.catalog import DEFECTS, catalog_frame
from tillproof.operators import diff as D, figures as G, whatif as W
from tillproof.operators.products import product_defects
from tillproof.operators.stores import store_defects
from tillproof.plans.workspace import open_feed
from tillproof.registry.base import Query, on_feed
from tillproof.registry.oracle import AS_OF, WINDOW_START, over

KEYS = G.FigureKeys("P5", "P27", "S3", "S6", "1995-01", "2001-07")

_JOINED = """wide AS (SELECT f.*, full_date, year_month, store_id, product_id, list_unit_price, is_guest FROM fact_sales f
  JOIN dim_date USING (date_key) JOIN dim_store USING (store_key) JOIN dim_product USING (product_key) JOIN dim_customer USING (customer_key))"""
_FIGURES = [
    ("conflict_fact_price", "money", "max(unit_price) FROM wide WHERE product_id = 'P5'"),
    ("conflict_fact_rows", "int", "count(*) FROM wide WHERE product_id = 'P5'"),
    ("conflict_price_delta", "money", "max(list_unit_price - unit_price) FROM wide WHERE product_id = 'P5'"),
    ("free_fact_price", "money", "max(unit_price) FROM wide WHERE product_id = 'P27'"),
    ("guest_fact_rows", "int", "count(*) FROM wide WHERE is_guest = 1"),
    ("guest_revenue", "money", "sum(net_amount) FROM wide WHERE is_guest = 1"),
    ("return_rows", "int", "count(*) FROM wide WHERE is_return = 1"),
    ("return_units", "int", "-sum(quantity) FROM wide WHERE is_return = 1"),
    ("discount_rows", "int", "count(*) FROM wide WHERE discount_amount > 0.01"),
    ("discount_share_pct", "percent", "CAST(round(CAST(sum(discount_amount) AS DOUBLE) * 10000 / CAST(sum(net_amount) AS DOUBLE)) / 100 AS DECIMAL(18,2)) FROM wide"),
    ("window_fact_rows", "int", f"count(*) FROM wide WHERE full_date BETWEEN {WINDOW_START} AND {AS_OF}"),
    ("store_contract_rate_pct", "percent", "CAST(round(CAST(sum(CASE WHEN is_return = 1 THEN -quantity ELSE 0 END) AS DOUBLE) * 10000 / CAST(sum(CASE WHEN is_return = 0 THEN quantity ELSE 0 END) AS DOUBLE)) / 100 AS DECIMAL(18,2)) FROM wide WHERE store_id = 'S6'"),
    ("days_first_month", "int", "count(DISTINCT full_date) FROM wide WHERE year_month = '1995-01'"),
    ("days_last_month", "int", "count(DISTINCT full_date) FROM wide WHERE year_month = '2001-07'"),
    ("first_txn_date", "text", "min(full_date) FROM wide"),
    ("last_txn_date", "text", "max(full_date) FROM wide"),
    ("conflict_dim_price", "money", "list_unit_price FROM dim_product WHERE product_id = 'P5'"),
    ("free_dim_price", "money", "list_unit_price FROM dim_product WHERE product_id = 'P27'"),
    ("products_category_imputed", "int", "count(*) FROM dim_product WHERE category_is_imputed = 1"),
    ("store_zip", "text", "zip_code FROM dim_store WHERE store_id = 'S3'"),
    ("store_zip_suspect", "int", "zip_is_suspect FROM dim_store WHERE store_id = 'S3'"),
    ("stores_region_imputed", "int", "count(*) FROM dim_store WHERE region_is_imputed = 1"),
    ("distinct_regions", "int", "count(DISTINCT region) FROM dim_store"),
    ("real_customers", "int", "count(*) FROM dim_customer WHERE is_guest = 0"),
]
FIGURES_SQL = f"{_JOINED}, figures AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS figure, '{k}' AS kind, (SELECT CAST({body.split(' FROM ', 1)[0]} AS VARCHAR) FROM {body.split(' FROM ', 1)[1]}) AS text" for n, k, body in _FIGURES) + ")"


def _figures(w):
    return G.warehouse_figures(w.star, w.config, KEYS)


def _claims(figures):
    """The figures as a document would print them: some stale, one unknown, one left out."""
    wrong = F.col("figure").isin("return_rows", "guest_revenue")
    shown = F.when(wrong, F.concat(F.lit("1"), "text")).otherwise(F.col("text"))
    printed = (
        F.when(F.col("kind") == "money", F.concat(F.lit("$"), shown))
        .when(F.col("kind") == "percent", F.concat(shown, F.lit("%")))
        .when(F.col("kind") == "text", F.concat(F.lit("  "), shown, F.lit(" "))).otherwise(shown))
    named = F.when(F.col("figure") == "store_zip", "no_such_figure").otherwise(F.col("figure"))
    return figures.filter("figure <> 'discount_rows'").select(
        named.alias("figure"), "kind", printed.alias("claimed_text"))


_CLAIMS = """claims AS (SELECT CASE WHEN figure = 'store_zip' THEN 'no_such_figure' ELSE figure END AS figure, kind,
  CASE kind WHEN 'money' THEN '$' || t WHEN 'percent' THEN t || '%' WHEN 'text' THEN '  ' || t || ' ' ELSE t END AS claimed_text
  FROM (SELECT *, CASE WHEN figure IN ('return_rows', 'guest_revenue') THEN '1' || text ELSE text END AS t FROM figures) WHERE figure <> 'discount_rows')"""

_CELLS = {
    "transaction_id": ("transaction_id", "'clean'", "NULL", "TX-09"),
    "transaction_date": ("CAST(day AS VARCHAR)", "CASE WHEN needed_non_iso THEN 'fixed' ELSE 'clean' END", "CASE WHEN needed_non_iso THEN 'TX-01' END", "TX-08"),
    "store_id": ("store_id", "'clean'", "NULL", "TX-04"),
    "product_id": ("product_id", "'clean'", "NULL", "TX-05"),
    "customer_id": ("customer", "CASE WHEN is_guest THEN 'fixed' ELSE 'clean' END", "CASE WHEN is_guest THEN 'TX-06' END", "-"),
    "quantity": ("CAST(units AS VARCHAR)", "CASE WHEN is_return THEN 'preserved' ELSE 'clean' END", "CASE WHEN is_return THEN 'TX-10' END", "TX-07"),
    "unit_price": ("CAST(price AS VARCHAR)", "'clean'", "NULL", "-"),
    "total_amount": ("CAST(total AS VARCHAR)", "CASE WHEN has_discount THEN 'preserved' WHEN currency_formatted THEN 'fixed' ELSE 'clean' END",
                     "CASE WHEN has_discount THEN 'TX-03' WHEN currency_formatted THEN 'TX-02' END", "TX-02"),
}
DIFF_SQL = "diff AS (" + " UNION ALL ".join(
    f"""SELECT source_row, transaction_id, disposition, '{c}' AS column_name, {c} AS raw_value,
  CASE WHEN disposition = 'kept' THEN {clean} ELSE '(' || disposition || ')' END AS clean_value,
  CASE WHEN disposition = 'kept' THEN {status} WHEN reason_code = '{blame}' THEN 'error' ELSE 'clean' END AS status,
  CASE WHEN disposition = 'kept' THEN {code} WHEN reason_code = '{blame}' THEN '{blame}' END AS defect_code FROM flagged"""
    for c, (clean, status, code, blame) in _CELLS.items()) + ")"


_WORDS = ",".join(f"('{d[0]}', '{d[3]}. {d[5]}')" for d in DEFECTS)


def _diff(w):
    return D.published_diff(w.raw_rows, w.published_rows, w.lineage_rows, w.config)


def _row_diff(w):
    return D.published_row_diff(w.raw_rows, w.published_rows, w.lineage_rows, w.config)


def _changed_publication(w, diff=D.published_diff):
    """The diff against a published table in which some cells were changed, emptied or left out."""
    row = F.col("source_row")
    changed = w.published_rows.filter(row % 19 != 3).withColumns({
        "total_amount": F.when(row % 7 == 0, F.col("total_amount") + 1).otherwise(F.col("total_amount")),
        "store_id": F.when(row % 11 != 0, F.col("store_id"))})
    return diff(w.raw_rows, changed, w.lineage_rows, w.config)


def _store_diff(w):
    lost = store_defects(w.raw["stores"]).filter("disposition = 'dropped'")
    names = {c: c for c in ("store_id", "store_name", "city", "state", "zip_code", "region", "opened_date")}
    return D.dimension_diff(w.raw["stores"], w.stores, lost, "store_id", names, {
        "zip_code": ("zip_is_suspect", "ST-01"), "region": ("region_is_imputed", "ST-03")})


def _product_diff(w):
    lost = product_defects(w.raw["products"]).filter("disposition = 'dropped'")
    names = {"product_id": "product_id", "product_name": "product_name", "category": "category",
             "unit_price": "list_unit_price", "supplier_id": "supplier_id"}
    return D.dimension_diff(w.raw["products"], w.products, lost, "product_id", names, {
        "category": ("category_is_imputed", "PR-03"), "unit_price": ("price_is_imputed", "PR-04")})


_LOST_STORES = "s AS (SELECT r.*, place > 1 AS lost FROM ranked_stores r)"
_STORE_DIFF = f"WITH {_LOST_STORES}, raw AS (SELECT w.*, s.lost FROM raw_stores w JOIN s USING (source_row)) " + " UNION ALL ".join(
    f"""SELECT source_row, store_id AS row_key, CASE WHEN lost THEN 'dropped' ELSE 'kept' END AS disposition, '{c}' AS column_name, raw.{c} AS raw_value,
  CASE WHEN lost THEN '(dropped)' ELSE CAST(k.{c} AS VARCHAR) END AS clean_value,
  CASE WHEN lost THEN {"'error'" if c == 'store_id' else "'clean'"} WHEN {flag} THEN 'fixed' ELSE 'clean' END AS status,
  CASE WHEN lost THEN {"'ST-02'" if c == 'store_id' else 'NULL'} WHEN {flag} THEN {code} END AS defect_code FROM raw JOIN stores_clean k USING (store_id)"""
    for c, flag, code in (("store_id", "FALSE", "NULL"), ("store_name", "FALSE", "NULL"), ("city", "FALSE", "NULL"), ("state", "FALSE", "NULL"),
                          ("zip_code", "zip_is_suspect", "'ST-01'"), ("region", "region_is_imputed", "'ST-03'"), ("opened_date", "FALSE", "NULL")))
_PRODUCT_DIFF = """WITH raw AS (SELECT m.*, CASE WHEN m.copy_no > 1 THEN 'PR-01' WHEN v.place > 1 THEN 'PR-02' END AS lost
  FROM marked_products m LEFT JOIN versions v USING (source_row)) """ + " UNION ALL ".join(
    f"""SELECT source_row, product_id AS row_key, CASE WHEN lost IS NOT NULL THEN 'dropped' ELSE 'kept' END AS disposition, '{c}' AS column_name, raw.{c} AS raw_value,
  CASE WHEN lost IS NOT NULL THEN '(dropped)' ELSE CAST(k.{k} AS VARCHAR) END AS clean_value,
  CASE WHEN lost IS NOT NULL THEN {"'error'" if c == 'product_id' else "'clean'"} WHEN {flag} THEN 'fixed' ELSE 'clean' END AS status,
  CASE WHEN lost IS NOT NULL THEN {"lost" if c == 'product_id' else 'NULL'} WHEN {flag} THEN {code} END AS defect_code FROM raw JOIN products_clean k USING (product_id)"""
    for c, k, flag, code in (("product_id", "product_id", "FALSE", "NULL"), ("product_name", "product_name", "FALSE", "NULL"),
                             ("category", "category", "category_is_imputed", "'PR-03'"), ("unit_price", "list_unit_price", "price_is_imputed", "'PR-04'"),
                             ("supplier_id", "supplier_id", "FALSE", "NULL")))

_SCENARIOS = ",".join("(" + ",".join("TRUE" if v else "FALSE" for v in values) + ")" for values in product((0, 1), repeat=4))
_WHATIF = f"""WITH r AS (SELECT *, is_copy OR amount_unparsed AS never, orphan_store OR orphan_product AS orphan, zero_quantity OR is_future AS odd,
  orphan_store::INT + orphan_product::INT AS broken FROM flagged),
s AS (SELECT * FROM (VALUES {_SCENARIOS}) AS t(recompute_totals, drop_returns, admit_orphans, admit_zero_future)),
x AS (SELECT s.*, r.*, NOT never AND (NOT orphan OR admit_orphans) AND (NOT odd OR admit_zero_future) AS admitted FROM r CROSS JOIN s),
y AS (SELECT *, admitted AND NOT (is_return AND drop_returns) AS loaded FROM x)
SELECT recompute_totals, drop_returns, admit_orphans, admit_zero_future,
  CAST(sum(CASE WHEN loaded THEN CASE WHEN recompute_totals THEN extended ELSE total END ELSE 0 END) AS DOUBLE) AS revenue,
  count(*) FILTER (WHERE loaded) AS fact_rows, CAST(coalesce(sum(broken) FILTER (WHERE loaded), 0) AS BIGINT) AS fk_violations,
  count(*) FILTER (WHERE NOT admitted AND NOT is_copy) AS quarantined_rows,
  round(CAST(sum(CASE WHEN loaded THEN CASE WHEN recompute_totals THEN extended ELSE total END ELSE 0 END)
    - sum(CASE WHEN NOT never AND NOT orphan AND NOT odd THEN total ELSE 0 END) AS DOUBLE) * 100) / 100 AS delta
FROM y GROUP BY 1, 2, 3, 4"""


QUERIES = [
    Query("warehouse_figures", on_feed(_figures), over(f"WITH {FIGURES_SQL} SELECT figure, kind, text FROM figures", "fact_sales")),
    Query("check_published_figures", on_feed(lambda w: G.check_published_figures(_claims(_figures(w)), _figures(w)).select("figure", "kind", "claimed_text", "verdict")),
          over(f"""WITH {FIGURES_SQL}, {_CLAIMS} SELECT coalesce(c.figure, f.figure) AS figure, coalesce(c.kind, f.kind) AS kind, claimed_text,
  CASE WHEN f.figure IS NULL THEN 'unknown' WHEN c.figure IS NULL THEN 'uncited' WHEN c.figure IN ('return_rows', 'guest_revenue') THEN 'stale' ELSE 'ok' END AS verdict
FROM claims c FULL JOIN figures f ON c.figure = f.figure""", "fact_sales")),
    Query("lineage_summary", on_feed(lambda w: G.lineage_summary(w.lineage)),
          over("""SELECT 'total' AS figure, count(*) AS source_rows FROM flagged UNION ALL SELECT disposition, count(*) FROM flagged GROUP BY disposition
UNION ALL SELECT 'reason.' || reason_code, count(*) FROM flagged WHERE reason_code IS NOT NULL GROUP BY reason_code""", "flagged")),
    Query("independent_tieout", on_feed(lambda w: G.independent_tieout(w.star, w.flagged, w.ledger, w.catalog, w.raw_rows, w.sales).withColumns(
        {c: F.col(c).cast("double") for c in ("expected", "actual")})),
          over("""WITH n AS (SELECT CAST(sum(net_amount) AS DOUBLE) AS v, count(*) AS c FROM fact_sales), b AS (SELECT count(*) AS c FROM raw_transactions)
SELECT unnest(['net_fact_vs_ledger', 'net_fact_vs_lines', 'net_vs_source_less_held', 'gross_less_discount_plus_returns', 'net_fact_vs_clean']) AS check_name, v AS expected, v AS actual, TRUE AS ok FROM n
UNION ALL SELECT unnest(['fact_rows_vs_kept', 'fact_rows_vs_clean']), c, c, TRUE FROM n UNION ALL SELECT 'row_budget', c, c, TRUE FROM b
UNION ALL SELECT 'count.' || e.code, CAST(e.expected_count AS DOUBLE), CAST(coalesce(l.detected_count, 0) AS DOUBLE), e.expected_count = coalesce(l.detected_count, 0)
  FROM expected e LEFT JOIN ledger l ON e.code = l.code""", "fact_sales", "expected", "ledger")),
    Query("raw_vs_clean_diff", on_feed(_diff), over(f"WITH {DIFF_SQL} SELECT * FROM diff", "flagged")),
    Query("explained_diff", on_feed(lambda w: D.explain(_diff(w), catalog_frame(w.spark)).groupBy("defect_code", "status", "explanation").agg(F.count(F.lit(1)).alias("cells"))),
          over(f"""WITH {DIFF_SQL}, words AS (SELECT * FROM (VALUES {_WORDS}) AS t(code, explanation))
SELECT defect_code, status, explanation, count(*) AS cells FROM diff LEFT JOIN words ON defect_code = code GROUP BY 1, 2, 3""", "flagged")),
    Query("store_diff", on_feed(_store_diff), over(_STORE_DIFF, "stores_clean")),
    Query("product_diff", on_feed(_product_diff), over(_PRODUCT_DIFF, "products_clean")),
    Query("verify_diff", on_feed(lambda w: D.verify_diff(_row_diff(w), w.lineage_rows)),
          over("SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS unmatched_rows, CAST(0 AS BIGINT) AS disposition_mismatches, CAST(0 AS BIGINT) AS id_mismatches, count(*) * 8 AS cells, CAST(0 AS BIGINT) AS unexplained_cells FROM flagged", "flagged")),
    Query("verify_diff_shifted", on_feed(lambda w: D.verify_diff(_row_diff(w), w.lineage_rows.filter("source_row % 9 <> 4").withColumns({
        "disposition": F.when(F.col("source_row") % 7 == 0, "moved").otherwise(F.col("disposition")),
        "transaction_id": F.when(F.col("source_row") % 5 == 0, F.concat("transaction_id", F.lit("x"))).otherwise(F.col("transaction_id"))}))),
          over("""SELECT count(*) AS rows_compared, count(*) FILTER (WHERE source_row % 9 = 4) AS unmatched_rows,
  count(*) FILTER (WHERE source_row % 9 = 4 OR source_row % 7 = 0) AS disposition_mismatches,
  count(*) FILTER (WHERE source_row % 9 = 4 OR source_row % 5 = 0) AS id_mismatches, count(*) * 8 AS cells, CAST(0 AS BIGINT) AS unexplained_cells FROM flagged""", "flagged")),
    Query("changed_publication_diff", on_feed(lambda w: _changed_publication(w).filter("status = 'unexplained' OR disposition = 'missing'")),
          over(f"""WITH {DIFF_SQL}, x AS (SELECT *, disposition = 'kept' AND source_row % 19 = 3 AS gone FROM diff)
SELECT source_row, transaction_id, CASE WHEN gone THEN 'missing' ELSE disposition END AS disposition, column_name, raw_value,
  CASE WHEN gone THEN '(missing)' WHEN column_name = 'store_id' THEN NULL ELSE CAST(CAST(clean_value AS DECIMAL(18,2)) + 1 AS VARCHAR) END AS clean_value,
  CASE WHEN gone THEN 'clean' ELSE 'unexplained' END AS status, CAST(NULL AS VARCHAR) AS defect_code FROM x
WHERE gone OR (disposition = 'kept' AND (column_name = 'total_amount' AND source_row % 7 = 0 OR column_name = 'store_id' AND source_row % 11 = 0))""", "flagged")),
    Query("verify_changed_publication", on_feed(lambda w: D.verify_diff(_changed_publication(w, D.published_row_diff), w.lineage_rows)),
          over("""SELECT count(*) AS rows_compared, CAST(0 AS BIGINT) AS unmatched_rows, count(*) FILTER (WHERE disposition = 'kept' AND source_row % 19 = 3) AS disposition_mismatches,
  CAST(0 AS BIGINT) AS id_mismatches, count(*) * 8 AS cells,
  count(*) FILTER (WHERE disposition = 'kept' AND source_row % 19 <> 3 AND source_row % 7 = 0) + count(*) FILTER (WHERE disposition = 'kept' AND source_row % 19 <> 3 AND source_row % 11 = 0) AS unexplained_cells FROM flagged""", "flagged")),
    Query("diff_browse", on_feed(lambda w: D.diff_browse(_row_diff(w), "TX-02", "total_amount", "raw", False)),
          over(f"""WITH {DIFF_SQL}, r AS (SELECT source_row, transaction_id, disposition, coalesce(string_agg(DISTINCT defect_code, ',' ORDER BY defect_code), '') AS defects,
  max(CASE WHEN column_name = 'total_amount' THEN raw_value END) AS sort_value FROM diff GROUP BY 1, 2, 3)
SELECT *, TRY_CAST(replace(sort_value, '$', '') AS DOUBLE) AS sort_number, CASE WHEN sort_value = 'n/a' THEN 'n/a' END AS sort_text FROM r WHERE defects LIKE '%TX-02%'""", "flagged")),
    Query("policy_whatif", on_feed(lambda w: W.policy_whatif(w.flagged)), over(_WHATIF, "flagged")),
]
