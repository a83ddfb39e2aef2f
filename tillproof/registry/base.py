"""What a registered query is, and the helpers they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillproof.plans.workspace import Workspace, open_feed


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def on_feed(build: Callable[[Workspace], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(open_feed(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Odd texts of every kind, spread over the orders by residues of the key. One statement
# serves both sides; only the name of the text type differs.
MESSY = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 16 WHEN 0 THEN x || CASE WHEN o_orderkey % 32 = 0 THEN '49999999' ELSE '' END WHEN 1 THEN '$' || x WHEN 2 THEN x || ' USD'
    WHEN 3 THEN '(' || x || ')' WHEN 4 THEN '−' || x WHEN 5 THEN '+' || x WHEN 6 THEN '  ' || x || ' '
    WHEN 7 THEN 'N/A' WHEN 8 THEN '' WHEN 9 THEN '   ' WHEN 10 THEN NULL WHEN 11 THEN 'nan'
    WHEN 12 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS {S}), 3, '0') || '.5' WHEN 13 THEN '€' || x
    WHEN 14 THEN x || 'd' ELSE '($' || x || ')' END AS amount_text,
  CASE o_orderkey % 10 WHEN 0 THEN n WHEN 1 THEN n || '.0' WHEN 2 THEN n || CASE WHEN o_orderkey % 20 = 2 THEN '.0000001' ELSE '.7' END WHEN 3 THEN '1,' || lpad(n, 3, '0')
    WHEN 4 THEN '−' || n WHEN 5 THEN 'x' || n WHEN 6 THEN NULL WHEN 7 THEN ' ' || n || ' ' WHEN 8 THEN '0'
    ELSE '-' || n END AS int_text,
  CASE o_orderkey % 11 WHEN 0 THEN d WHEN 1 THEN substr(d,6,2) || '/' || substr(d,9,2) || '/' || substr(d,1,4)
    WHEN 2 THEN substr(d,9,2) || '-' || substr(d,6,2) || '-' || substr(d,1,4)
    WHEN 3 THEN '5/3/' || substr(d,1,4) WHEN 4 THEN substr(d,1,4) || '-02-30' WHEN 5 THEN '31/12/' || substr(d,1,4)
    WHEN 6 THEN d || ' x' WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN 'soon' ELSE ' ' || d || ' ' END AS date_text,
  CASE o_orderkey % 6 WHEN 0 THEN lpad(n, 5, '1') WHEN 1 THEN n WHEN 2 THEN 'N/A'
    WHEN 3 THEN lpad(n, 5, '1') || '-1234' WHEN 4 THEN NULL ELSE '938' END AS zip_text,
  CASE o_orderkey % 11 WHEN 0 THEN 'true' WHEN 1 THEN 'T' WHEN 2 THEN 'Yes' WHEN 3 THEN 'y' WHEN 4 THEN '1'
    WHEN 5 THEN 'FALSE' WHEN 6 THEN 'f' WHEN 7 THEN 'no' WHEN 8 THEN 'n' WHEN 9 THEN '0' ELSE '0.0' END AS flag_text,
  CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN '  ' || o_orderpriority WHEN 2 THEN '   '
    WHEN 3 THEN NULL ELSE '' END AS name_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'S' || n WHEN 1 THEN 'CUST-' || n WHEN 2 THEN n ELSE 'a b' || n END AS id_text
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS {S}) AS x, CAST(o_orderkey % 997 AS {S}) AS n,
    CAST(CAST(o_orderdate AS DATE) AS {S}) AS d FROM {orders}) t"""


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSY.replace("{S}", "STRING"), orders=table(spark, sf_dir, "orders"))


MESSY_SQL = "messy AS (" + MESSY.replace("{S}", "VARCHAR").replace("{orders}", "orders") + ")"
