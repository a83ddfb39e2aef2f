"""The same feed as one SQL prelude, for the side-by-side check of every query."""

from __future__ import annotations

from tillproof.plans.feed import NATION_STATES, STATE_LABELS


def _list(values) -> str:
    return "[" + ",".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


STORES = f"""
raw_stores AS (
  SELECT s_suppkey * 2 + copy AS source_row,
    'S' || s_suppkey AS store_id,
    CASE WHEN copy = 1 THEN 'A ' || s_name ELSE s_name END AS store_name,
    CASE WHEN copy = 1 AND s_suppkey % 40 = 6 THEN NULL ELSE n_name END AS city,
    ({_list(NATION_STATES)})[s_nationkey + 1] AS state,
    CASE WHEN s_suppkey % 10 = 3 THEN CAST(1000 + s_suppkey * 7 % 8999 AS VARCHAR)
         ELSE CAST(10000 + s_suppkey * 37 % 89999 AS VARCHAR) END AS zip_code,
    CASE WHEN s_suppkey % 7 = 2 OR s_nationkey % 12 = 5 THEN NULL
         ELSE ({_list(STATE_LABELS)})[s_nationkey + 1] END AS region,
    CAST(1990 + s_suppkey % 30 - CASE WHEN copy = 1 AND s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR)
      || '-' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0')
      || '-' || lpad(CAST(s_suppkey % 28 + 1 AS VARCHAR), 2, '0') AS opened_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  CROSS JOIN (VALUES (0), (1)) AS c(copy)
  WHERE copy = 0 OR s_suppkey % 20 = 6)"""

PRODUCTS = """
raw_products AS (
  SELECT p_partkey * 4 + copy AS source_row, 'P' || p_partkey AS product_id,
    p_name AS product_name,
    CASE WHEN p_partkey % 6 = 3 THEN NULL ELSE p_type END AS category,
    CASE WHEN p_partkey % 9 = 4 THEN '$' ELSE '' END || CAST(CAST(
      CASE WHEN p_partkey % 40 = 27 THEN 0
           WHEN copy = 1 THEN CAST(p_retailprice AS DECIMAL(18,2)) + 8.50
           ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS VARCHAR) AS unit_price,
    p_brand AS supplier_id
  FROM part CROSS JOIN (VALUES (0), (1), (2)) AS c(copy)
  WHERE copy = 0 OR (copy = 1 AND p_partkey % 60 = 5)
     OR (copy = 2 AND (p_partkey % 50 = 12 OR p_partkey % 120 = 65)))"""

TRANSACTIONS = """
lines AS (
  SELECT *, row_number() OVER () - 1 AS pos FROM lineitem),
sold AS (
  SELECT l.*, o_custkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship,
    CASE WHEN l_orderkey % 97 = 5 THEN 0
         WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INTEGER)
         ELSE CAST(l_quantity AS INTEGER) END AS units
  FROM lines l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
raw_transactions AS (
  SELECT pos * 2 + copy AS source_row,
    'T' || l_orderkey || '-' || l_linenumber || '-' || pos AS transaction_id,
    CASE WHEN l_orderkey % 25 = 0 THEN substr(ship,6,2) || '/' || substr(ship,9,2) || '/' || substr(ship,1,4)
         WHEN l_orderkey % 25 = 1 THEN substr(ship,9,2) || '-' || substr(ship,6,2) || '-' || substr(ship,1,4)
         ELSE ship END AS transaction_date,
    CASE WHEN l_orderkey % 61 = 7 THEN 'S9999' ELSE 'S' END || l_suppkey AS store_id,
    CASE WHEN l_orderkey % 67 = 9 THEN 'P9999999' ELSE 'P' END || l_partkey AS product_id,
    CASE WHEN o_custkey % 12 = 0 THEN NULL ELSE 'C' || o_custkey END AS customer_id,
    CAST(units AS VARCHAR) AS quantity,
    CAST(price AS VARCHAR) AS unit_price,
    CASE WHEN l_orderkey % 211 = 17 THEN 'n/a'
         ELSE CASE WHEN l_orderkey % 20 = 2 THEN '$' ELSE '' END || CAST(CAST(round(
           units * price * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS VARCHAR)
         END AS total_amount
  FROM sold CROSS JOIN (VALUES (0), (1)) AS c(copy)
  WHERE copy = 0 OR l_orderkey % 33 = 4)"""
