"""Registered queries for readers and writers: each writes to a new folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillproof.config import FEED_CONFIG as CONFIG
from tillproof.operators import metrics as M
from tillproof.operators.audit import coverage
from tillproof.operators.profile import profile_datasets
from tillproof.plans.bundle import run_bundle
from tillproof.plans.workspace import open_feed
from tillproof.registry.base import Query, on_feed, table
from tillproof.registry.oracle import over
from tillproof.scale import new_folder
from tillproof.schemas import RAW_COLUMNS, STORES_CLEAN
from tillproof.sources import files, sinks


def _feed_folder(w) -> str:
    folder = new_folder(w.spark, "feed")
    for name, df in w.raw.items():
        sinks.write_csv(df.select(*RAW_COLUMNS[name]), f"{folder}/{name}.csv")
    return folder


def _read_csv(w):
    folder = _feed_folder(w)
    return files.read_text_csv(w.spark, f"{folder}/transactions.csv")


def _source_rows(w):
    """Every row gets its own place, 0 to N-1."""
    df = files.read_text_csv(w.spark, f"{_feed_folder(w)}/transactions.csv", keep_blank_as_na=False)
    placed = files.with_source_row(w.spark, df, "feed")
    return placed.agg(
        F.count(F.lit(1)).alias("source_rows"), F.min("source_row").alias("first_place"),
        F.max("source_row").alias("last_place"), F.count_distinct("source_row").alias("places"))


def _read_feed(w):
    feed = files.read_feed(w.spark, _feed_folder(w))
    parts = [
        df.agg(F.count(F.lit(1)).alias("source_rows"), F.count(df.columns[-1]).alias("last_column_held")).withColumn("dataset", F.lit(n))
        .withColumn("columns", F.lit(len(df.columns))) for n, df in feed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _csv_out(w):
    path = sinks.write_csv(w.sales, new_folder(w.spark, "csv"))
    return files.read_text_csv(w.spark, path)


def _json_out(spark, sf_dir):
    odd = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).when(
        F.col("s_suppkey") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("s_acctbal"))
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", odd.alias("ratio"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("day"),
        F.array(F.lit("b"), F.col("s_name"), F.lit("a")).alias("tags"))
    path = sinks.write_json(df, new_folder(spark, "json"))
    back = spark.read.schema("s_suppkey long, ratio double, day string, tags array<string>").json(path)
    return back.withColumn("tags", F.concat_ws(",", "tags"))


def _slices(w):
    """The quarantine written in two calls; the second adds to the first."""
    folder = new_folder(w.spark, "slices")
    for _ in range(2):
        sinks.quarantine_sink([w.quarantine.drop("reason_detail")], folder)
    back = w.spark.read.option("header", True).csv(folder)
    return back.groupBy("dataset", "reason_code").agg(F.count(F.lit(1)).alias("slice_rows"))


def _lineage_out(w):
    path = sinks.lineage_sink(w.lineage, new_folder(w.spark, "lineage"))
    return w.spark.read.parquet(path).select(
        "source_row", "transaction_id", "disposition", "reason_code", F.col("total_amount_as_reported").cast("double").alias("total_amount_as_reported"))


_KEYS = {"dim_date": "date_key", "dim_store": "store_key", "dim_product": "product_key", "dim_customer": "customer_key",
         "fact_sales": "sales_key"}


def _star_out(spark, sf_dir):
    w = open_feed(spark, sf_dir)
    target = new_folder(spark, "swapped")
    staged = sinks.staging_folder(target)
    sinks.write_tables(w.star, staged)
    star = sinks.read_star(spark, sinks.publish(spark, staged, target))
    parts = [df.agg(F.count(F.lit(1)).alias("table_rows"), F.sum(F.col(_KEYS[n]).cast("long")).alias("key_sum")).withColumn(
        "table_name", F.lit(n)) for n, df in star.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _views(w):
    """The published tables through temp views and plain SQL."""
    sinks.read_star(w.spark, w.star_path, views=True)
    return w.spark.sql("""
SELECT d.year, s.region, count(*) AS sales, CAST(sum(f.net_amount) AS DOUBLE) AS net
FROM fact_sales f JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key) GROUP BY d.year, s.region""")


def _bundle(w):
    doc = run_bundle(
        {"as_of": CONFIG.as_of, "window_start": CONFIG.window_start},
        {"coverage": coverage(w.catalog, w.ledger), "audit": w.ledger, "profile": profile_datasets(w.raw, CONFIG)},
        M.run_metrics(w.spark, w.star, CONFIG))
    rows = lambda section: F.count_if(F.col("section") == section)
    total = lambda section, field: F.coalesce(F.sum(F.when(
        F.col("section") == section, F.get_json_object("record", f"$.{field}").cast("decimal(28,2)"))), F.lit(0)).cast("double")
    return doc.agg(
        F.max(F.when(F.col("section") == "metadata", F.get_json_object("record", "$.as_of"))).alias("as_of"),
        rows("coverage").alias("coverage_rows"), rows("audit").alias("audit_rows"), rows("profile").alias("profile_rows"),
        *[rows(f"metrics.{m}").alias(m) for m in M.METRICS],
        total("audit", "detected_count").alias("detected"), total("profile", "row_count").alias("profiled_cells"),
        total("profile", "null_count").alias("profiled_nulls"), total("metrics.mom_growth_by_category", "net_revenue").alias("growth_net"),
        total("metrics.revenue_reconciliation", "net_revenue").alias("net_revenue"))


QUERIES = [
    Query("read_text_csv", on_feed(_read_csv),
          over("SELECT transaction_id, transaction_date, store_id, product_id, customer_id, quantity, unit_price, nullif(total_amount, 'n/a') AS total_amount FROM raw_transactions", "raw_transactions")),
    Query("source_row_identity", on_feed(_source_rows),
          over("SELECT count(*) AS source_rows, CAST(0 AS BIGINT) AS first_place, count(*) - 1 AS last_place, count(*) AS places FROM raw_transactions", "raw_transactions")),
    Query("read_feed", on_feed(_read_feed),
          over("""SELECT 'stores' AS dataset, 7 AS columns, count(*) AS source_rows, count(opened_date) AS last_column_held FROM raw_stores
UNION ALL SELECT 'products', 5, count(*), count(supplier_id) FROM raw_products
UNION ALL SELECT 'transactions', 8, count(*), count(nullif(total_amount, 'n/a')) FROM raw_transactions""", "raw_stores", "raw_products", "raw_transactions")),
    Query("write_csv", on_feed(_csv_out),
          over("SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in (
              "transaction_id", "transaction_date", "store_id", "product_id", "customer_id", "is_guest", "quantity", "unit_price",
              "extended_amount", "total_amount", "discount_amount", "has_discount", "is_return")) + " FROM sales", "sales")),
    Query("write_json", _json_out,
          """SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 1 THEN s_acctbal END AS ratio, CAST(DATE '2001-01-01' + CAST(s_suppkey AS INTEGER) AS VARCHAR) AS day,
  s_name || ',a,b' AS tags FROM supplier"""),
    Query("table_records", on_feed(lambda w: sinks.table_records(w.stores, ["store_id"], 20)),
          over(f"""SELECT store_id, to_json(struct_pack({', '.join(f"{c} := {'CAST(opened_date AS VARCHAR)' if c == 'opened_date' else c}" for c in STORES_CLEAN)}))::VARCHAR AS record
FROM stores_clean ORDER BY store_id LIMIT 20""", "stores_clean")),
    Query("quarantine_sink", on_feed(_slices),
          over("SELECT dataset, reason_code, 2 * count(*) AS slice_rows FROM slices GROUP BY 1, 2", "slices")),
    Query("lineage_sink", on_feed(_lineage_out),
          over("SELECT source_row, transaction_id, disposition, reason_code, CAST(total AS DOUBLE) AS total_amount_as_reported FROM flagged", "flagged")),
    Query("star_sink", _star_out,
          over(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS table_rows, CAST(sum({_KEYS[t]}) AS BIGINT) AS key_sum FROM {t}" for t in sinks.STAR_TABLES), "fact_sales")),
    Query("star_source", on_feed(_views),
          over("SELECT d.year, s.region, count(*) AS sales, CAST(sum(f.net_amount) AS DOUBLE) AS net FROM fact_sales f JOIN dim_date d USING (date_key) JOIN dim_store s USING (store_key) GROUP BY d.year, s.region", "fact_sales")),
    Query("run_bundle", on_feed(_bundle),
          over(f"""SELECT '{CONFIG.as_of}' AS as_of, CAST(17 AS BIGINT) AS coverage_rows, CAST(17 AS BIGINT) AS audit_rows, CAST(20 AS BIGINT) AS profile_rows,
  least(5, (SELECT count(DISTINCT store_key) FROM fact_sales JOIN dim_date USING (date_key) WHERE full_date BETWEEN DATE '{CONFIG.window_start}' AND DATE '{CONFIG.as_of}')) AS top_stores_recent_30d,
  (SELECT count(*) FROM (SELECT DISTINCT category, year_month FROM fact_sales JOIN dim_date USING (date_key) JOIN dim_product USING (product_key))) AS mom_growth_by_category,
  (SELECT count(DISTINCT store_key) FROM fact_sales) AS return_rate_by_store,
  (SELECT count(DISTINCT region) FROM fact_sales JOIN dim_store USING (store_key) WHERE is_return = 0) AS aov_by_region,
  CAST(10 AS BIGINT) AS top_customers_lifetime, CAST(1 AS BIGINT) AS revenue_reconciliation, (SELECT CAST(sum(net_amount) AS DOUBLE) FROM fact_sales) AS net_revenue,
  (SELECT CAST(sum(net_amount) AS DOUBLE) FROM fact_sales) AS growth_net, (SELECT CAST(count(*) AS DOUBLE) FROM detections WHERE counted) AS detected,
  CAST({' + '.join(f"{len(RAW_COLUMNS[n])} * (SELECT count(*) FROM raw_{n})" for n in RAW_COLUMNS)} AS DOUBLE) AS profiled_cells,
  CAST({' + '.join(f"(SELECT count(*) - count({c}) FROM raw_{n})" for n in RAW_COLUMNS for c in RAW_COLUMNS[n])} AS DOUBLE) AS profiled_nulls""", "fact_sales", "detections")),
]
