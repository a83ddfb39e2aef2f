"""Registered queries for the star schema and the metrics over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillproof.config import FEED_CONFIG as CONFIG
from tillproof.operators import adhoc, metrics as M, star as X
from tillproof.operators.constraints import CHECKS, FOREIGN, NOT_NULL, UNIQUE, constraint_suite
from tillproof.plans.workspace import open_feed
from tillproof.registry.base import Query, on_feed
from tillproof.registry.oracle import AS_OF, WINDOW_START, over
from tillproof.scale import new_folder

_MONEY = ("unit_price", "extended_amount", "discount_amount", "net_amount", "list_unit_price")


def _out(df):
    return df.withColumns({c: F.col(c).cast("double") for c in df.columns if c in _MONEY})


def _cols(columns) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _MONEY else c for c in columns)


DIM_DATE = ("date_key", "full_date", "year", "quarter", "month", "year_month", "month_name", "day_of_month", "day_of_week", "is_weekend")


def _violations() -> str:
    parts = []
    for table, checks in CHECKS.items():
        parts += [f"SELECT '{table}' AS table_name, 'check' AS kind, '{n}' AS constraint_name, count(*) FILTER (WHERE NOT ({sql})) AS violations FROM {table}"
                  for n, sql in checks.items()]
        parts += [f"SELECT '{table}', 'not_null', '{c}', count(*) - count({c}) FROM {table}" for c in NOT_NULL[table]]
        parts += [f"SELECT '{table}', 'unique', '{c}', (SELECT count(*) FROM (SELECT {c} FROM {table} GROUP BY {c} HAVING count(*) > 1))" for c in UNIQUE[table]]
    parts += [f"SELECT 'fact_sales', 'fk', '{c}', count(*) FROM fact_sales WHERE {c} NOT IN (SELECT {c} FROM {d})" for c, d in FOREIGN.items()]
    return " UNION ALL ".join(parts)


def _load(spark, sf_dir):
    """A whole build from the cleaned tables to a new published folder."""
    w = open_feed(spark, sf_dir)
    return X.load_star(w.stores, w.products, w.sales, CONFIG, new_folder(spark, "star-again")).withColumn(
        "fact_net", F.col("fact_net").cast("double"))


def _unresolved_quarantine(w):
    """What a load leaves behind that fails: sales of two stores and of a product are given unknown keys."""
    lost = w.sales.withColumns({
        "store_id": F.when(F.col("store_id").isin("S3", "S6"), F.concat("store_id", F.lit("x"))).otherwise(F.col("store_id")),
        "product_id": F.when(F.col("product_id") == "P5", "P5x").otherwise(F.col("product_id"))})
    try:
        X.load_star(w.stores, w.products, lost, CONFIG, new_folder(w.spark, "star-lost"))
    except X.UnresolvedKeys as stop:
        return X.read_outcome(w.spark, stop.path, "unresolved").select("transaction_id", "store_id", "product_id", "missing_keys", F.col("net_amount").cast("double").alias("net_amount"))
    raise AssertionError("the load did not stop")


_LOAD_SQL = """SELECT (SELECT count(*) FROM fact_sales) AS fact_rows, (SELECT CAST(sum(net_amount) AS DOUBLE) FROM fact_sales) AS fact_net,
  (SELECT count(*) FROM sales) AS feed_rows, (SELECT count(*) FROM dim_store) AS store_rows, (SELECT count(*) FROM stores_clean) AS stores_in,
  (SELECT count(*) FROM dim_product) AS product_rows, (SELECT count(*) FROM products_clean) AS products_in,
  (SELECT count(*) FROM dim_customer) AS customer_rows, (SELECT count(*) FROM dim_date) AS date_rows,
  CAST(0 AS BIGINT) AS fk_violations, CAST(0 AS BIGINT) AS tie_out_cents, TRUE AS ok"""


# The metrics from the cleaned sales alone, with window functions where the operators group,
# so they share neither text nor route with what they check.
_SOLD = """told AS (SELECT s.*, t.store_name, t.region AS of_region, p.category AS kind,
  CAST(CASE WHEN is_return THEN 1 ELSE 0 END AS BIGINT) AS back, CAST(total_amount AS DECIMAL(18,2)) AS net
  FROM sales s JOIN stores_clean t ON s.store_id = t.store_id JOIN products_clean p ON s.product_id = p.product_id)"""
METRIC_SQL = {
    "top_stores_recent_30d": f"""SELECT DISTINCT store_id, store_name, of_region AS region,
  CAST(sum(net) OVER w AS DOUBLE) AS net_revenue, count(*) OVER w AS transaction_count, CAST(sum(back) OVER w AS BIGINT) AS return_count
FROM told WHERE datediff('day', transaction_date, {AS_OF}) BETWEEN 0 AND 29 WINDOW w AS (PARTITION BY store_id)
ORDER BY net_revenue DESC, store_id LIMIT 5""",
    "mom_growth_by_category": """SELECT *, round((net_revenue - previous_revenue) / nullif(previous_revenue, 0) * 10000) / 100 AS growth_pct FROM (
  SELECT kind AS category, strftime(transaction_date, '%Y-%m') AS year_month, CAST(sum(net) AS DOUBLE) AS net_revenue,
    count(DISTINCT transaction_date) AS days_with_data,
    lag(CAST(sum(net) AS DOUBLE)) OVER (PARTITION BY kind ORDER BY strftime(transaction_date, '%Y-%m')) AS previous_revenue
  FROM told GROUP BY 1, 2)""",
    "return_rate_by_store": f"""SELECT store_id, store_name, region, transaction_count, return_count, units_sold, units_returned,
  round(return_count * 10000.0::DOUBLE / transaction_count) / 100 AS txn_return_rate_pct,
  round(units_returned * 10000.0::DOUBLE / nullif(units_sold + units_returned, 0)) / 100 AS unit_return_rate_pct,
  CASE WHEN units_returned > {CONFIG.return_rate_alert} * (units_sold + units_returned) THEN 1 ELSE 0 END AS above_alert
FROM (SELECT store_id, any_value(store_name) AS store_name, any_value(of_region) AS region, count(*) AS transaction_count,
    count(*) FILTER (WHERE is_return) AS return_count, CAST(coalesce(sum(quantity) FILTER (WHERE quantity > 0), 0) AS BIGINT) AS units_sold,
    CAST(coalesce(-sum(quantity) FILTER (WHERE quantity < 0), 0) AS BIGINT) AS units_returned FROM told GROUP BY store_id)""",
    "aov_by_region": """SELECT of_region AS region, count(*) AS sale_count, CAST(sum(net) AS DOUBLE) AS sales_total,
  round(CAST(sum(net) AS DOUBLE) / count(*) * 100) / 100 AS avg_sale FROM told WHERE quantity > 0 GROUP BY 1""",
    "top_customers_lifetime": """SELECT customer_id, count(*) AS transaction_count, CAST(sum(net) AS DOUBLE) AS lifetime_net,
  round(CAST(sum(net) AS DOUBLE) / count(*) * 100) / 100 AS avg_transaction FROM told WHERE NOT is_guest GROUP BY 1
QUALIFY row_number() OVER (ORDER BY sum(net) DESC, customer_id) <= 10""",
    "revenue_reconciliation": """SELECT CAST(g AS DOUBLE) AS gross_sales, CAST(d AS DOUBLE) AS discount_total, CAST(g - d AS DOUBLE) AS gross_less_discount,
  CAST(r AS DOUBLE) AS returns_total, CAST(n AS DOUBLE) AS net_revenue, CAST(x AS DOUBLE) AS line_level_delta, CAST(g - d + r - n AS DOUBLE) AS aggregate_delta
FROM (SELECT sum(extended_amount) FILTER (WHERE quantity > 0) AS g, sum(discount_amount) FILTER (WHERE quantity > 0) AS d,
    sum(net) FILTER (WHERE quantity < 0) AS r, sum(net) AS n, sum(extended_amount - discount_amount - net) FILTER (WHERE quantity > 0) AS x FROM told)""",
}


def _metric(metric: M.Metric) -> Query:
    return Query(
        metric.id, lambda spark, sf_dir: M.run_metric(spark, metric, open_feed(spark, sf_dir).star, CONFIG),
        over(f"WITH {_SOLD} {METRIC_SQL[metric.id]}", "sales", "stores_clean", "products_clean"))


def _resolve(w):
    keyed = X.resolve_surrogate_key(w.sales, w.star["dim_product"], "product_id", "product_id", "product_key")
    return keyed.select("transaction_id", "product_id", "product_key")


def _unresolved(w):
    typed = w.flagged.filter("not is_copy").select("transaction_id", F.col("store_id"))
    return X.unresolved(typed, w.star["dim_store"], "store_id", "store_id").groupBy("store_id").agg(F.count(F.lit(1)).alias("fact_rows"))


def _registry_units(w):
    """Each metric with its declared columns and the rows it returns now."""
    units = M.metric_units(w.spark).groupBy("metric").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(F.col("unit") == "percent").alias("percent_columns"))
    rows = None
    for name, df in M.run_metrics(w.spark, w.star, w.config).items():
        one = df.agg(F.count(F.lit(1)).alias("result_rows")).withColumn("metric", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return units.join(rows, "metric")


_RUN_ROWS = """SELECT 'top_stores_recent_30d' AS metric, CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS percent_columns, least(5, (SELECT count(DISTINCT store_key) FROM fact_sales
    JOIN dim_date USING (date_key) WHERE full_date BETWEEN {a} AND {b})) AS result_rows
UNION ALL SELECT 'mom_growth_by_category', 6, 1, (SELECT count(*) FROM (SELECT DISTINCT category, year_month FROM fact_sales JOIN dim_date USING (date_key) JOIN dim_product USING (product_key)))
UNION ALL SELECT 'return_rate_by_store', 10, 2, (SELECT count(DISTINCT store_key) FROM fact_sales)
UNION ALL SELECT 'aov_by_region', 4, 0, (SELECT count(DISTINCT region) FROM fact_sales JOIN dim_store USING (store_key) WHERE is_return = 0)
UNION ALL SELECT 'top_customers_lifetime', 4, 0, 10
UNION ALL SELECT 'revenue_reconciliation', 7, 0, 1""".replace("{a}", WINDOW_START).replace("{b}", AS_OF)


def _damaged(star):
    """The star with known damage, so that constraints have something to count."""
    key = F.col("sales_key")
    fact = star["fact_sales"].withColumns({
        "extended_amount": F.when(key % 5 == 0, F.col("extended_amount") + 5).otherwise(F.col("extended_amount")),
        "unit_price": F.when(key % 11 != 0, F.col("unit_price")),
        "product_key": F.when(key % 13 == 0, -key).otherwise(F.col("product_key")),
        "is_return": F.when(key % 17 == 0, 2).otherwise(F.col("is_return"))})
    people = star["dim_customer"]
    return {**star, "fact_sales": fact, "dim_customer": people.unionByName(people.filter("is_guest = 1"))}


_DAMAGE_SQL = """WITH f AS (SELECT sales_key AS k FROM fact_sales)
SELECT 'fact_sales' AS table_name, 'check' AS kind, 'extended_agrees' AS constraint_name, count(*) FILTER (WHERE k % 5 = 0 AND k % 11 <> 0) AS violations FROM f
UNION ALL SELECT 'fact_sales', 'check', 'discount_agrees', count(*) FILTER (WHERE k % 5 = 0) FROM f
UNION ALL SELECT 'fact_sales', 'check', unnest(['return_flag', 'return_sign_of_quantity', 'return_sign_of_money']), count(*) FILTER (WHERE k % 17 = 0) FROM f
UNION ALL SELECT 'fact_sales', 'not_null', 'unit_price', count(*) FILTER (WHERE k % 11 = 0) FROM f
UNION ALL SELECT 'fact_sales', 'fk', 'product_key', count(*) FILTER (WHERE k % 13 = 0) FROM f
UNION ALL SELECT 'dim_customer', 'unique', unnest(['customer_key', 'customer_id']), 1"""


QUERIES = [
    Query("dim_date", on_feed(lambda w: X.dim_date(w.sales, CONFIG)), over(f"SELECT {_cols(DIM_DATE)} FROM dim_date", "dim_date")),
    Query("dim_store", on_feed(lambda w: w.star["dim_store"]), over("SELECT * FROM dim_store", "dim_store")),
    Query("dim_product", on_feed(lambda w: _out(w.star["dim_product"])),
          over("SELECT * REPLACE (CAST(list_unit_price AS DOUBLE) AS list_unit_price) FROM dim_product", "dim_product")),
    Query("dim_customer", on_feed(lambda w: w.star["dim_customer"]), over("SELECT * FROM dim_customer", "dim_customer")),
    Query("resolve_surrogate_key", on_feed(_resolve),
          over("SELECT transaction_id, product_id, product_key FROM sales JOIN dim_product USING (product_id)", "sales", "dim_product")),
    Query("unresolved_keys", on_feed(_unresolved),
          over("SELECT store_id, count(*) AS fact_rows FROM flagged WHERE NOT is_copy AND store_id NOT IN (SELECT store_id FROM dim_store) GROUP BY store_id", "flagged", "dim_store")),
    Query("unresolved_quarantine", on_feed(_unresolved_quarantine),
          over("""SELECT transaction_id, CASE WHEN store_id IN ('S3', 'S6') THEN store_id || 'x' ELSE store_id END AS store_id,
  CASE WHEN product_id = 'P5' THEN 'P5x' ELSE product_id END AS product_id,
  concat_ws(',', CASE WHEN store_id IN ('S3', 'S6') THEN 'store_key' END, CASE WHEN product_id = 'P5' THEN 'product_key' END) AS missing_keys,
  CAST(total_amount AS DOUBLE) AS net_amount FROM sales WHERE store_id IN ('S3', 'S6') OR product_id = 'P5'""", "sales")),
    Query("fact_sales", on_feed(lambda w: _out(w.star["fact_sales"])),
          over("SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(extended_amount AS DOUBLE) AS extended_amount, CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(net_amount AS DOUBLE) AS net_amount) FROM fact_sales", "fact_sales")),
    Query("constraint_suite", on_feed(lambda w: constraint_suite(w.star)), over(_violations(), "fact_sales")),
    Query("constraint_suite_damaged", on_feed(lambda w: constraint_suite(_damaged(w.star)).filter("violations > 0")), over(_DAMAGE_SQL, "fact_sales")),
    Query("verify_star", on_feed(lambda w: X.verify_star(w.star, w.stores, w.products, w.sales).withColumn("fact_net", F.col("fact_net").cast("double"))),
          over(_LOAD_SQL, "fact_sales")),
    Query("load_star", _load, over(_LOAD_SQL, "fact_sales")),
    *[_metric(m) for m in M.METRICS.values()],
    Query("mom_growth_dense", on_feed(lambda w: M.mom_growth_dense(w.spark, w.star, w.config)),
          over("""WITH monthly AS (
  SELECT category, year_month, sum(net_amount) AS net FROM fact_sales JOIN dim_date USING (date_key) JOIN dim_product USING (product_key) GROUP BY 1, 2),
filled AS (
  SELECT c.category, d.year_month, coalesce(m.net, 0) AS net FROM (SELECT DISTINCT category FROM monthly) c
  CROSS JOIN (SELECT DISTINCT year_month FROM dim_date) d LEFT JOIN monthly m ON m.category = c.category AND m.year_month = d.year_month),
paired AS (SELECT *, lag(net) OVER (PARTITION BY category ORDER BY year_month) AS prev FROM filled)
SELECT category, year_month, CAST(net AS DOUBLE) AS net_revenue, CAST(prev AS DOUBLE) AS previous_revenue,
  round(CAST(net - prev AS DOUBLE) / nullif(CAST(prev AS DOUBLE), 0) * 10000) / 100 AS growth_pct FROM paired""", "fact_sales")),
    Query("metric_registry", on_feed(_registry_units), over(_RUN_ROWS, "fact_sales")),
    Query("return_sla_breaches", on_feed(lambda w: adhoc.return_sla_breaches(w.star)),
          over("""WITH u AS (SELECT store_id, store_name, region, count(*) AS n, sum(CASE WHEN quantity < 0 THEN -quantity ELSE 0 END) AS b,
  sum(CASE WHEN quantity > 0 THEN quantity ELSE 0 END) AS s FROM fact_sales JOIN dim_store USING (store_key) GROUP BY 1, 2, 3)
SELECT store_id, store_name, region, n AS total_transactions, CAST(b AS BIGINT) AS returned_units, CAST(s AS BIGINT) AS gross_sold_units,
  round(CAST(b AS DOUBLE) * 100 / nullif(s, 0) * 100) / 100 AS return_rate_pct,
  CASE WHEN CAST(b AS DOUBLE) * 100 / nullif(s, 0) > 10 THEN 'BREACH' ELSE 'COMPLIANT' END AS sla_status FROM u""", "fact_sales")),
    Query("store_revenue_ranking", on_feed(lambda w: adhoc.store_revenue_ranking(w.star)),
          over("""SELECT store_id, store_name, city, state, region, count(*) AS transaction_count, CAST(sum(net_amount) AS DOUBLE) AS net_revenue,
  round(CAST(sum(net_amount) AS DOUBLE) / count(*) * 100) / 100 AS average_ticket FROM fact_sales JOIN dim_store USING (store_key)
GROUP BY 1, 2, 3, 4, 5 ORDER BY sum(net_amount) DESC, store_id LIMIT 10""", "fact_sales")),
    Query("category_performance", on_feed(lambda w: adhoc.category_performance(w.star)),
          over("""SELECT category, count(*) AS total_orders, CAST(sum(quantity) AS BIGINT) AS net_units_sold, CAST(sum(net_amount) AS DOUBLE) AS net_sales,
  CAST(sum(discount_amount) AS DOUBLE) AS discounts_given, round(CAST(sum(list_unit_price) AS DOUBLE) / count(*) * 100) / 100 AS avg_list_price
FROM fact_sales JOIN dim_product USING (product_key) GROUP BY category""", "fact_sales")),
    Query("quarantine_root_cause", on_feed(lambda w: adhoc.quarantine_root_cause(w.quarantine)),
          over("""SELECT reason_code, CASE reason_code WHEN 'TX-09' THEN 'exact copy of an earlier row' WHEN 'TX-02' THEN 'a measure cannot be read'
    WHEN 'TX-07' THEN 'quantity is zero' WHEN 'TX-08' THEN 'date is after the reference date' WHEN 'TX-04' THEN 'store is not in the store table'
    WHEN 'TX-05' THEN 'product is not in the product table' ELSE title END AS reason_detail, s.dataset, count(*) AS held_rows, min(row_key) AS first_key, max(row_key) AS last_key,
  string_agg(row_key, ',' ORDER BY source_row, row_key) AS row_keys FROM slices s JOIN catalog c ON reason_code = c.code GROUP BY ALL ORDER BY held_rows DESC, reason_code""", "slices", "catalog")),
    Query("quarantine_cause_keys", on_feed(lambda w: adhoc.quarantine_cause_keys(w.quarantine).drop("reason_detail")),
          over("SELECT reason_code, dataset, source_row, row_key FROM slices", "slices")),
    Query("fk_audit", on_feed(lambda w: adhoc.fk_audit(w.star)),
          over(" UNION ALL ".join(
              f"SELECT 'fact_sales -> {d}' AS relationship, count(*) AS total_fact_rows, count(*) FILTER (WHERE {c} NOT IN (SELECT {c} FROM {d})) AS orphans, 'PASS' AS status FROM fact_sales"
              for c, d in FOREIGN.items()), "fact_sales")),
]
