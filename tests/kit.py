"""Small raw tables and row helpers for the tests."""

from __future__ import annotations

from pyspark.sql import types as T

from tillproof.config import RunConfig
from tillproof.operators import products as P, stores as S, transactions as X
from tillproof.scale import written
from tillproof.schemas import RAW_COLUMNS

CONFIG = RunConfig()


def raw(spark, name, rows):
    """Rows of one raw dataset, numbered from 0."""
    columns = RAW_COLUMNS[name]
    schema = T.StructType([T.StructField("source_row", T.LongType())] + [T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def by(df, key):
    return {r[key]: r for r in df.collect()}


STORES = [
    ("S001", "Main", "Rome", "NY", "14604", "Northeast", "2010-01-01"),
    ("S002", "Port", "Salem", "OR", "0938", None, "2011-01-01"),
    ("S003", "Bay", "Bend", "OR", "97001", "West", "2012-01-01"),
]
PRODUCTS = [
    ("P001", "Cap", "Apparel", "10.00", "V1"),
    ("P002", "Mug", "Home", "5.00", "V2"),
    ("P002", "Mug", "Home", "5.00", "V2"),
    ("P003", "Pen", None, "0.00", "V1"),
]


def sale(i, day="2026-05-15", store="S001", product="P001", customer="C1", q="2", price="10.00", total="20.00"):
    return (f"T{i}", day, store, product, customer, q, price, total)


TRANSACTIONS = [
    sale(1), sale(2, q="-1", total="-10.00"), sale(3, customer=None), sale(4, day="2026-07-01"),
    sale(5, q="0", total="0.00"), sale(6, store="S999"),
]


_DIMS = {}


def dims(spark, stores=STORES, products=PRODUCTS, config=CONFIG):
    """Cleaned stores and products, written once per content."""
    key = repr((spark.sparkContext.applicationId, stores, products))
    if key not in _DIMS:
        _DIMS[key] = (
            written(S.clean_stores(raw(spark, "stores", stores), config), "t-stores"),
            written(P.clean_products(raw(spark, "products", products), config), "t-products"))
    return _DIMS[key]


def flagged(spark, transactions=TRANSACTIONS, stores=STORES, products=PRODUCTS, config=CONFIG):
    return written(X.flag_transactions(
        raw(spark, "transactions", transactions), *dims(spark, stores, products, config), config), "t-flagged")
