"""Registered queries for the audit ledger and the coverage proof."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillproof.catalog import catalog_by_dataset
from tillproof.operators import audit as A
from tillproof.registry.base import Query, on_feed
from tillproof.registry.oracle import over

# Actions in SQL, from the rules: what is done about each class.
_ACTION = """CASE WHEN code IN ('ST-02','PR-01','TX-09') THEN 'dropped' WHEN code IN ('ST-01','PR-02') THEN 'flagged'
  WHEN code IN ('TX-03','TX-10') THEN 'preserved' WHEN code IN ('TX-04','TX-05','TX-07','TX-08') THEN 'quarantined' ELSE 'imputed' END"""
_NEVER = ("TX-04", "PR-02")


def _calls(w):
    """The ledger as if every code had been recorded once per outcome of its rows."""
    return w.detections.filter("counted").groupBy("code", "disposition").agg(
        F.count(F.lit(1)).alias("detected_count"), F.min("row_key").alias("_first"), F.max("row_key").alias("_last")
    ).select(
        "code", F.col("disposition").alias("call"), "detected_count",
        F.when(F.col("disposition") == "evidence", "flagged").otherwise(F.col("disposition")).alias("action"),
        F.array("_first", "_last").alias("affected_keys"), F.concat(F.lit("as "), "disposition").alias("notes"))


def _partial(w):
    """A ledger with two stages missing and one count off, so that the proof has work to do."""
    short = w.ledger.filter(~F.col("code").isin(*_NEVER))
    return short.withColumn(
        "detected_count", F.col("detected_count") + F.when(F.col("code") == "TX-07", 3).otherwise(0))


QUERIES = [
    Query("defect_catalog", on_feed(lambda w: w.catalog.select("position", "code", "dataset", "severity", "title", "expected_count")),
          over("SELECT c.position, c.code, c.dataset, c.severity, c.title, CAST(e.expected_count AS BIGINT) AS expected_count FROM catalog c JOIN expected e ON c.code = e.code", "catalog", "expected")),
    Query("catalog_by_dataset", on_feed(lambda w: catalog_by_dataset(w.catalog)),
          over("""SELECT dataset, string_agg(c.code, ',' ORDER BY c.code) AS codes, count(*) AS classes, CAST(sum(expected_count) AS BIGINT) AS expected_rows
FROM catalog c JOIN expected e ON c.code = e.code GROUP BY dataset""", "catalog", "expected")),
    Query("defect_ledger", on_feed(lambda w: w.ledger.withColumn("affected_keys", F.concat_ws(",", "affected_keys"))),
          over(f"""WITH firsts AS (
  SELECT code, string_agg(row_key, ',' ORDER BY place) AS affected_keys FROM (
    SELECT code, row_key, row_number() OVER (PARTITION BY code ORDER BY source_row) AS place FROM detections WHERE counted)
  WHERE place <= 50 GROUP BY code),
told AS (SELECT code, string_agg(n || ' ' || disposition, ', ' ORDER BY disposition) AS notes FROM (SELECT code, disposition, count(*) AS n FROM detections GROUP BY 1, 2) GROUP BY 1)
SELECT notes, l.code, l.detected_count, {_ACTION.replace('code IN', 'l.code IN')} AS action, affected_keys, l.detected_count AS affected_keys_total,
  l.detected_count > 50 AS affected_keys_truncated FROM ledger l JOIN firsts f ON l.code = f.code JOIN told t ON l.code = t.code""", "ledger", "detections")),
    Query("dimension_budget", on_feed(lambda w: w.dimension_budget),
          over("""SELECT 'stores' AS dataset, (SELECT count(*) FROM raw_stores) AS source_rows, (SELECT count(*) FROM stores_clean) AS kept,
  (SELECT count(*) - count(DISTINCT store_id) FROM raw_stores WHERE store_id IS NOT NULL) AS dropped,
  (SELECT count(*) FROM raw_stores WHERE store_id IS NULL) AS quarantined, TRUE AS balanced
UNION ALL SELECT 'products', (SELECT count(*) FROM raw_products), (SELECT count(*) FROM products_clean),
  (SELECT count(*) - count(DISTINCT product_id) FROM raw_products WHERE product_id IS NOT NULL),
  (SELECT count(*) FROM raw_products WHERE product_id IS NULL), TRUE""", "stores_clean", "products_clean")),
    Query("defect_keys", on_feed(lambda w: A.defect_keys(w.detections)),
          over("SELECT code, source_row, row_key FROM detections WHERE counted", "detections")),
    Query("merged_keys", on_feed(lambda w: A.merged_keys(_calls(w)).select("code", "row_key", "call")),
          over("""WITH calls AS (SELECT code, disposition AS call, min(row_key) AS a, max(row_key) AS b FROM detections WHERE counted GROUP BY code, disposition)
SELECT code, row_key, min(call) AS call FROM (SELECT code, call, a AS row_key FROM calls UNION ALL SELECT code, call, b FROM calls) GROUP BY 1, 2""", "detections")),
    Query("merge_records", on_feed(lambda w: A.merge_records(_calls(w)).withColumn("affected_keys", F.concat_ws(",", "affected_keys"))),
          over("""WITH calls AS (
  SELECT code, disposition AS call, count(*) AS n, CASE WHEN disposition = 'evidence' THEN 'flagged' ELSE disposition END AS action,
    min(row_key) AS a, max(row_key) AS b FROM detections WHERE counted GROUP BY code, disposition),
keys AS (
  SELECT code, key, min(rank) AS rank FROM (
    SELECT code, a AS key, call || '1' AS rank FROM calls UNION ALL SELECT code, b, call || '2' FROM calls) GROUP BY code, key)
SELECT code, CAST(sum(n) AS BIGINT) AS detected_count, string_agg(action, '+' ORDER BY call) AS action,
  (SELECT string_agg(key, ',' ORDER BY rank) FROM keys k WHERE k.code = calls.code) AS affected_keys,
  string_agg('as ' || call, ' | ' ORDER BY call) AS notes, count(*) AS merged_from_calls FROM calls GROUP BY code""", "detections")),
    Query("coverage_check", on_feed(lambda w: A.coverage_check(w.catalog, _partial(w))),
          over("""SELECT c.code, c.dataset, CASE WHEN c.code IN ('TX-04', 'PR-02') THEN 'NEVER RECORDED' ELSE 'COUNT MISMATCH' END AS problem,
  CAST(e.expected_count AS BIGINT) AS expected_count, CASE WHEN c.code = 'TX-07' THEN l.detected_count + 3 ELSE 0 END AS detected_count,
  CASE WHEN c.code = 'TX-07' THEN l.detected_count + 3 - CAST(e.expected_count AS BIGINT) END AS delta
FROM catalog c JOIN expected e ON c.code = e.code JOIN ledger l ON c.code = l.code WHERE c.code IN ('TX-04', 'PR-02', 'TX-07')""", "catalog", "expected", "ledger")),
    Query("coverage_summary", on_feed(lambda w: A.coverage(w.catalog, w.ledger).select(
        "position", "code", "dataset", "severity", "expected_count", "detected_count", "action", "status", "board_status")),
          over(f"""SELECT c.position, c.code, c.dataset, c.severity, CAST(e.expected_count AS BIGINT) AS expected_count, coalesce(l.detected_count, 0) AS detected_count,
  {_ACTION.replace('code IN', 'c.code IN')} AS action, CASE WHEN coalesce(l.detected_count, 0) = e.expected_count THEN 'OK' ELSE 'MISMATCH' END AS status,
  CASE WHEN coalesce(l.detected_count, 0) = e.expected_count THEN 'match' ELSE 'mismatch' END AS board_status
FROM catalog c JOIN expected e ON c.code = e.code LEFT JOIN ledger l ON c.code = l.code""", "catalog", "expected", "ledger")),
    Query("audit_totals", on_feed(lambda w: A.audit_totals(w.catalog, w.ledger, w.quarantine)),
          over("""SELECT count(*) AS classes_in_catalog, count(l.code) AS classes_detected, count(*) - count(l.code) AS classes_never_recorded,
  CAST(sum(l.detected_count) AS BIGINT) AS rows_affected, count(*) FILTER (WHERE l.detected_count <> e.expected_count) AS mismatches,
  (SELECT count(*) FROM slices) AS rows_quarantined
FROM catalog c JOIN expected e ON c.code = e.code LEFT JOIN ledger l ON c.code = l.code""", "catalog", "expected", "ledger", "slices")),
    Query("quarantine_dispositions", on_feed(lambda w: A.quarantine_dispositions(w.detections)),
          over("SELECT dataset, code, disposition, count(*) AS slice_rows FROM detections GROUP BY ALL", "detections")),
    Query("defect_listing", on_feed(lambda w: A.defect_listing(
        w.catalog, w.ledger, dataset="transactions", text="row", sort_by="severity").select("code", "severity", "severity_rank", "detected_count")),
          over("""SELECT c.code, c.severity, CASE c.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank, l.detected_count
FROM catalog c JOIN ledger l ON c.code = l.code WHERE c.code IN ('TX-04','TX-05','TX-06','TX-07','TX-08','TX-09','TX-10')""", "catalog", "ledger")),
]
