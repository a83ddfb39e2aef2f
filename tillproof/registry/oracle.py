"""SQL views of the feed and of every stage after it, for the side-by-side checks.

They are written from the rules alone, with plain window functions over whole tables, so
they share no code and no method with the Spark operators they check.
"""

from __future__ import annotations

from tillproof.catalog import DEFECTS, STATE_REGIONS
from tillproof.config import FEED_CONFIG
from tillproof.registry.feed_sql import PRODUCTS, STORES, TRANSACTIONS

AS_OF = f"DATE '{FEED_CONFIG.as_of}'"
WINDOW_START = f"DATE '{FEED_CONFIG.window_start}'"


def _values(rows) -> str:
    return ",".join("(" + ",".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_stores": ((), STORES),
    "raw_products": ((), PRODUCTS),
    "raw_transactions": ((), TRANSACTIONS),
    "catalog": ((), f"""
catalog AS (SELECT * FROM (VALUES {_values([(i, *d[:4]) for i, d in enumerate(DEFECTS)])})
  AS c(position, code, dataset, severity, title))"""),
    "geography": ((), f"""
geography AS (SELECT * FROM (VALUES {_values(sorted(STATE_REGIONS.items()))}) AS g(state, geo_region))"""),
    "ranked_stores": (("raw_stores",), """
padded_stores AS (
  SELECT * REPLACE (CASE WHEN regexp_full_match(zip_code, '[0-9]{1,5}')
      THEN repeat('0', 5 - length(zip_code)) || zip_code ELSE zip_code END AS zip_code),
    NOT regexp_full_match(zip_code, '[0-9]{5}') AS zip_is_suspect,
    CAST(opened_date AS DATE) AS opened,
    (store_id IS NULL)::INT + (store_name IS NULL)::INT + (city IS NULL)::INT + (state IS NULL)::INT
      + (zip_code IS NULL)::INT + (region IS NULL)::INT + (opened_date IS NULL)::INT AS holes
  FROM raw_stores),
ranked_stores AS (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY holes, opened NULLS LAST, store_name, source_row) AS place,
    count(*) OVER (PARTITION BY store_id) AS group_rows,
    CASE WHEN count(*) OVER (PARTITION BY store_id) = 1 THEN NULL
      WHEN max(holes) OVER w <> min(holes) OVER w THEN 'fewest_nulls'
      WHEN max(opened) OVER w <> min(opened) OVER w THEN 'earliest_opened_date'
      WHEN max(store_name) OVER w <> min(store_name) OVER w THEN 'first_store_name'
      ELSE 'row_order_fallback' END AS decided_by
  FROM padded_stores WINDOW w AS (PARTITION BY store_id))"""),
    "state_map": (("ranked_stores", "geography"), """
state_map AS (
  SELECT s.state, coalesce(s.seen, g.geo_region, 'Unknown') AS mapped_value,
    CASE WHEN s.seen IS NOT NULL THEN 'observed' WHEN g.geo_region IS NOT NULL THEN 'geography'
      ELSE 'unknown' END AS map_source
  FROM (SELECT state, min(region) AS seen FROM ranked_stores WHERE place = 1 GROUP BY state) s
  LEFT JOIN (SELECT * FROM geography WHERE geo_region IN (
      SELECT region FROM ranked_stores WHERE place = 1 AND region IS NOT NULL)) g ON s.state = g.state)"""),
    "stores_clean": (("state_map",), """
stores_clean AS (
  SELECT store_id, store_name, city, r.state, zip_code, zip_is_suspect,
    coalesce(region, mapped_value) AS region, region IS NULL AS region_is_imputed, opened AS opened_date
  FROM ranked_stores r JOIN state_map m ON r.state = m.state WHERE place = 1)"""),
    "settled_products": (("raw_products",), """
priced_products AS (
  SELECT *, CAST(replace(unit_price, '$', '') AS DECIMAL(18,2)) AS price FROM raw_products),
marked_products AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, product_name, category, unit_price, supplier_id
    ORDER BY source_row) AS copy_no FROM priced_products),
versions AS (
  SELECT *, count(*) OVER k AS group_rows, max(price) OVER k AS top, max(price) OVER k - min(price) OVER k AS spread,
    row_number() OVER (PARTITION BY product_id ORDER BY price DESC, source_row) AS place
  FROM marked_products WHERE copy_no = 1 WINDOW k AS (PARTITION BY product_id)),
settled_products AS (SELECT * FROM versions WHERE place = 1)"""),
    "products_clean": (("settled_products",), """
category_medians AS (
  SELECT category, median(price) AS m FROM settled_products WHERE price > 0 AND category IS NOT NULL GROUP BY category),
products_clean AS (
  SELECT product_id, product_name, coalesce(s.category, 'Unknown') AS category,
    s.category IS NULL AS category_is_imputed,
    CAST(round(CASE WHEN price > 0 THEN price ELSE coalesce(m,
      (SELECT median(price) FROM settled_products WHERE price > 0)) END, 2) AS DECIMAL(18,2)) AS list_unit_price,
    price <= 0 AS price_is_imputed, spread > 0 AS price_conflict, supplier_id
  FROM settled_products s LEFT JOIN category_medians c ON s.category = c.category)"""),
    "flagged": (("raw_transactions",), f"""
parsed AS (
  SELECT *,
    row_number() OVER (PARTITION BY transaction_id, transaction_date, store_id, product_id, customer_id,
      quantity, unit_price, total_amount ORDER BY source_row) > 1 AS is_copy,
    CAST(CASE WHEN transaction_date LIKE '%/%'
        THEN substr(transaction_date,7,4) || '-' || substr(transaction_date,1,2) || '-' || substr(transaction_date,4,2)
      WHEN substr(transaction_date,3,1) = '-'
        THEN substr(transaction_date,7,4) || '-' || substr(transaction_date,4,2) || '-' || substr(transaction_date,1,2)
      ELSE transaction_date END AS DATE) AS day,
    CASE WHEN transaction_date LIKE '%/%' THEN '%m/%d/%Y'
      WHEN substr(transaction_date,3,1) = '-' THEN '%d-%m-%Y' ELSE '%Y-%m-%d' END AS fmt,
    CAST(quantity AS BIGINT) AS units, CAST(unit_price AS DECIMAL(18,2)) AS price,
    TRY_CAST(replace(total_amount, '$', '') AS DECIMAL(18,2)) AS total
  FROM raw_transactions),
flags AS (
  SELECT *, fmt <> '%Y-%m-%d' AS needed_non_iso,
    fmt <> '%Y-%m-%d' AND day(day) <= 12 AND day(day) <> month(day) AS date_is_ambiguous,
    total_amount IN ('n/a') OR total_amount LIKE '$%' AS currency_formatted,
    total IS NULL AS amount_unparsed, customer_id IS NULL AS is_guest,
    coalesce(customer_id, 'GUEST') AS customer,
    coalesce(units < 0 AND total < 0, FALSE) AS is_return,
    units = 0 AS zero_quantity, day > {AS_OF} AS is_future,
    store_id LIKE 'S9999%' AS orphan_store, product_id LIKE 'P9999999%' AS orphan_product,
    CAST(units * price AS DECIMAL(18,2)) AS extended
  FROM parsed),
flagged AS (
  SELECT *, CASE WHEN NOT amount_unparsed AND units <> 0 THEN CAST(extended - total AS DECIMAL(18,2)) END AS discount,
    coalesce(NOT amount_unparsed AND units <> 0 AND abs(extended - total) > 0.01, FALSE) AS has_discount,
    CASE WHEN is_copy THEN 'TX-09' WHEN amount_unparsed THEN 'TX-02' WHEN zero_quantity THEN 'TX-07'
      WHEN is_future THEN 'TX-08' WHEN orphan_store THEN 'TX-04' WHEN orphan_product THEN 'TX-05' END AS reason_code,
    CASE WHEN is_copy THEN 'dropped' WHEN amount_unparsed OR zero_quantity OR is_future OR orphan_store
      OR orphan_product THEN 'quarantined' ELSE 'kept' END AS disposition
  FROM flags)"""),
    "sales": (("flagged",), """
sales AS (
  SELECT transaction_id, day AS transaction_date, store_id, product_id, customer AS customer_id, is_guest,
    units AS quantity, price AS unit_price, extended AS extended_amount, total AS total_amount,
    discount AS discount_amount, has_discount, is_return
  FROM flagged WHERE disposition = 'kept')"""),
    "dim_date": (("sales",), f"""
dim_date AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, CAST(d AS DATE) AS full_date,
    CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
    strftime(d, '%Y-%m') AS year_month, strftime(d, '%B') AS month_name,
    CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofweek(d) AS INTEGER) AS day_of_week,
    CAST(dayofweek(d) IN (0, 6) AS INTEGER) AS is_weekend
  FROM (SELECT unnest(generate_series(min(transaction_date),
      greatest(max(transaction_date), {AS_OF}), INTERVAL 1 DAY)) AS d FROM sales))"""),
    "dim_store": (("stores_clean",), """
dim_store AS (
  SELECT row_number() OVER (ORDER BY store_id) AS store_key, store_id, store_name, city, state, zip_code,
    CAST(zip_is_suspect AS INTEGER) AS zip_is_suspect, region,
    CAST(region_is_imputed AS INTEGER) AS region_is_imputed, opened_date FROM stores_clean)"""),
    "dim_product": (("products_clean",), """
dim_product AS (
  SELECT row_number() OVER (ORDER BY product_id) AS product_key, product_id, product_name, category,
    CAST(category_is_imputed AS INTEGER) AS category_is_imputed, list_unit_price,
    CAST(price_is_imputed AS INTEGER) AS price_is_imputed, CAST(price_conflict AS INTEGER) AS price_conflict,
    supplier_id FROM products_clean)"""),
    "dim_customer": (("sales",), """
dim_customer AS (
  SELECT row_number() OVER (ORDER BY customer_id) AS customer_key, customer_id,
    CAST(customer_id = 'GUEST' AS INTEGER) AS is_guest
  FROM (SELECT customer_id FROM sales UNION SELECT 'GUEST'))"""),
    "fact_sales": (("dim_date", "dim_store", "dim_product", "dim_customer"), """
fact_sales AS (
  SELECT row_number() OVER (ORDER BY transaction_id) AS sales_key, transaction_id, date_key, store_key,
    product_key, customer_key, quantity, unit_price, extended_amount, discount_amount,
    total_amount AS net_amount, CAST(is_return AS INTEGER) AS is_return
  FROM sales JOIN dim_date ON transaction_date = full_date JOIN dim_store USING (store_id)
  JOIN dim_product USING (product_id) JOIN dim_customer USING (customer_id))"""),
    "detections": (("flagged", "ranked_stores", "settled_products"), """
detections AS (
  SELECT 'ST-01' AS code, 'stores' AS dataset, source_row, store_id AS row_key, 'evidence' AS disposition, TRUE AS counted
    FROM ranked_stores WHERE zip_is_suspect
  UNION ALL SELECT 'ST-02', 'stores', source_row, store_id, CASE WHEN place = 1 THEN 'evidence' ELSE 'dropped' END, place > 1
    FROM ranked_stores WHERE group_rows > 1
  UNION ALL SELECT 'ST-03', 'stores', source_row, store_id, 'evidence', TRUE FROM ranked_stores WHERE place = 1 AND region IS NULL
  UNION ALL SELECT 'PR-01', 'products', source_row, product_id, 'dropped', TRUE FROM marked_products WHERE copy_no > 1
  UNION ALL SELECT 'PR-02', 'products', source_row, product_id, CASE WHEN place = 1 THEN 'evidence' ELSE 'dropped' END, place > 1
    FROM versions WHERE group_rows > 1
  UNION ALL SELECT 'PR-03', 'products', first_row, product_id, 'evidence', TRUE
    FROM (SELECT *, min(source_row) OVER (PARTITION BY product_id) AS first_row FROM versions) WHERE place = 1 AND category IS NULL
  UNION ALL SELECT 'PR-04', 'products', first_row, product_id, 'evidence', TRUE
    FROM (SELECT *, min(source_row) OVER (PARTITION BY product_id) AS first_row FROM versions) WHERE place = 1 AND price <= 0
  UNION ALL SELECT code, 'transactions', source_row, transaction_id,
      CASE WHEN disposition = 'kept' THEN 'evidence' ELSE disposition END, TRUE
    FROM flagged CROSS JOIN (VALUES ('TX-01'), ('TX-02'), ('TX-03'), ('TX-04'), ('TX-05'), ('TX-06'), ('TX-07'),
      ('TX-08'), ('TX-09'), ('TX-10')) AS t(code)
    WHERE CASE code WHEN 'TX-01' THEN needed_non_iso WHEN 'TX-02' THEN currency_formatted WHEN 'TX-03' THEN has_discount
      WHEN 'TX-04' THEN orphan_store WHEN 'TX-05' THEN orphan_product WHEN 'TX-06' THEN is_guest
      WHEN 'TX-07' THEN zero_quantity WHEN 'TX-08' THEN is_future WHEN 'TX-09' THEN is_copy ELSE is_return END)"""),
    "slices": (("detections", "catalog"), """
slices AS (
  SELECT dataset, code AS reason_code, source_row, row_key, disposition FROM detections
    WHERE code IN ('ST-01','ST-02','PR-01','PR-02','PR-04')
  UNION ALL SELECT 'transactions', 'TX-09', source_row, transaction_id, disposition FROM flagged WHERE is_copy
  UNION ALL SELECT 'transactions', 'TX-02', source_row, transaction_id, disposition FROM flagged WHERE amount_unparsed
  UNION ALL SELECT 'transactions', 'TX-07', source_row, transaction_id, disposition FROM flagged WHERE zero_quantity
  UNION ALL SELECT 'transactions', 'TX-08', source_row, transaction_id, disposition FROM flagged WHERE is_future
  UNION ALL SELECT 'transactions', 'TX-04', source_row, transaction_id, disposition FROM flagged WHERE orphan_store
  UNION ALL SELECT 'transactions', 'TX-05', source_row, transaction_id, disposition FROM flagged WHERE orphan_product)"""),
    "ledger": (("detections",), """
ledger AS (SELECT code, count(*) FILTER (WHERE counted) AS detected_count FROM detections GROUP BY code)"""),
    "expected": ((), f"""
planted AS (
  SELECT l.*, o_custkey, CASE WHEN l_orderkey % 33 = 4 THEN 2 ELSE 1 END AS n,
    l_orderkey % 211 <> 17 AND l_orderkey % 97 <> 5 AS measured
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey),
expected AS (
  SELECT 'ST-01' AS code, count(*) AS expected_count FROM supplier WHERE s_suppkey % 10 = 3
  UNION ALL SELECT 'ST-02', count(*) FROM supplier WHERE s_suppkey % 20 = 6
  UNION ALL SELECT 'ST-03', count(*) FROM supplier WHERE s_suppkey % 7 = 2 OR s_nationkey IN (5, 17, 23, 24)
  UNION ALL SELECT 'PR-01', count(*) FROM part WHERE p_partkey % 50 = 12 OR p_partkey % 120 = 65
  UNION ALL SELECT 'PR-02', count(*) FROM part WHERE p_partkey % 60 = 5
  UNION ALL SELECT 'PR-03', count(*) FROM part WHERE p_partkey % 6 = 3
  UNION ALL SELECT 'PR-04', count(*) FROM part WHERE p_partkey % 40 = 27
  UNION ALL SELECT 'TX-01', sum(n) FROM planted WHERE l_orderkey % 25 IN (0, 1)
  UNION ALL SELECT 'TX-02', sum(n) FROM planted WHERE l_orderkey % 211 = 17 OR l_orderkey % 20 = 2
  UNION ALL SELECT 'TX-03', sum(n) FROM planted WHERE measured AND l_discount > 0
  UNION ALL SELECT 'TX-04', sum(n) FROM planted WHERE l_orderkey % 61 = 7
  UNION ALL SELECT 'TX-05', sum(n) FROM planted WHERE l_orderkey % 67 = 9
  UNION ALL SELECT 'TX-06', sum(n) FROM planted WHERE o_custkey % 12 = 0
  UNION ALL SELECT 'TX-07', sum(n) FROM planted WHERE l_orderkey % 97 = 5
  UNION ALL SELECT 'TX-08', sum(n) FROM planted WHERE CAST(l_shipdate AS DATE) > {AS_OF}
  UNION ALL SELECT 'TX-09', sum(n - 1) FROM planted
  UNION ALL SELECT 'TX-10', sum(n) FROM planted WHERE measured AND l_returnflag = 'R')"""),
}


def over(tail: str, *views: str) -> str:
    """``tail`` with the views it needs, and what they need, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    if not order:
        return tail
    head = ",".join(VIEWS[v][1] for v in order)
    rest = tail.lstrip()
    if rest.upper().startswith("WITH "):
        return f"WITH {head}, {rest[5:]}"
    return f"WITH {head}\n{rest}"
