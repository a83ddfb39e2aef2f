"""Registered queries for the profiling operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillproof.config import FEED_CONFIG as CONFIG
from tillproof.operators import profile as P, star as X
from tillproof.registry.base import Query, on_feed, table
from tillproof.registry.oracle import AS_OF, over
from tillproof.scale import written
from tillproof.schemas import RAW_COLUMNS
from tillproof.sources.files import parquet_with_row_place

TX = list(RAW_COLUMNS["transactions"])
SETS = {name: list(cols) for name, cols in RAW_COLUMNS.items()}


def _cells(name: str) -> str:
    return "cells AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, {c} AS v, source_row FROM raw_{name}" for i, c in enumerate(SETS[name])) + ")"


def _pct(top: str, bottom: str) -> str:
    return f"coalesce(round({top} * 1e6 / nullif({bottom}, 0)) / 1e6, 0.0)"


NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
_BARE = "regexp_replace(v, '[$€£¥₹, ]', '', 'g')"
_IS = {
    "int_rate": r"regexp_full_match(replace(v, ',', ''), '[+-]?\d+')",
    "decimal_rate": f"regexp_full_match(replace(v, ',', ''), '{NUMBER}')",
    "currency_rate": f"regexp_full_match({_BARE}, '{NUMBER}')",
    "date_rate": r"(regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}') OR regexp_full_match(v, '\d{1,2}/\d{1,2}/\d{4}') OR regexp_full_match(v, '\d{1,2}-\d{1,2}-\d{4}'))",
    "identifier_rate": r"regexp_full_match(v, '[A-Za-z][A-Za-z0-9]*[-_]?\d+')",
}
EVIDENCE = "evidence AS (SELECT column_name, any_value(position) AS position, count(v) AS observable_count, " + ", ".join(
    f"{_pct(f'count(*) FILTER (WHERE {t})', 'count(v)')} AS {n}" for n, t in _IS.items()
) + f", count(*) FILTER (WHERE regexp_matches(v, '[$€£¥₹,]')) AS marker_count, count(DISTINCT v) AS distinct_tokens, {_pct('count(DISTINCT v)', 'count(v)')} AS distinct_ratio FROM cells GROUP BY column_name)"
_KEYISH = "(identifier_rate >= 0.95 OR (regexp_matches(column_name, '(_id|_key|id|code)$') AND identifier_rate >= 0.5))"
TYPES = f"""types AS (SELECT *, CASE WHEN observable_count = 0 THEN 'empty' WHEN date_rate >= 0.95 THEN 'date'
  WHEN marker_count > 0 AND currency_rate >= 0.95 THEN 'currency_string' WHEN int_rate >= 0.95 THEN 'integer'
  WHEN decimal_rate >= 0.95 THEN 'decimal' WHEN {_KEYISH} AND distinct_tokens * 2 >= observable_count THEN 'identifier'
  WHEN distinct_tokens <= 25 AND distinct_tokens * 2 <= observable_count THEN 'categorical'
  WHEN {_KEYISH} THEN 'identifier' ELSE 'free_text' END AS semantic_type FROM evidence),
trusted AS (SELECT *, CASE semantic_type WHEN 'date' THEN date_rate WHEN 'currency_string' THEN currency_rate WHEN 'integer' THEN int_rate
  WHEN 'decimal' THEN decimal_rate WHEN 'identifier' THEN identifier_rate ELSE 1.0 END AS confidence FROM types)"""
_BAD = f"""CASE semantic_type WHEN 'integer' THEN NOT {_IS['int_rate']} WHEN 'decimal' THEN NOT {_IS['decimal_rate']}
  WHEN 'currency_string' THEN NOT {_IS['currency_rate']} WHEN 'date' THEN NOT {_IS['date_rate']} ELSE FALSE END"""
_NUM = f"CASE WHEN {_IS['currency_rate']} THEN CAST({_BARE} AS DECIMAL(28,6)) END"


def _one_profile(name: str) -> str:
    """The whole profile of one dataset as a select over its cells."""
    return f"""SELECT t.column_name, t.position, row_count, null_count, CAST(0 AS BIGINT) AS blank_count, row_count - null_count AS non_null_count,
  {_pct('null_count', 'row_count')} AS null_pct, distinct_count, {_pct('distinct_count', 'row_count')} AS distinct_pct,
  distinct_count = row_count AS is_unique, distinct_count = 1 AS is_constant, semantic_type, confidence, parse_failure_count,
  min_value, max_value, sum_value, mean_value, zero_count, negative_count, n.marker_count, '{name}' AS dataset
FROM trusted t JOIN (SELECT c.column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count,
    count(*) FILTER (WHERE v IS NOT NULL AND {_BAD}) AS parse_failure_count
  FROM cells c JOIN types ty ON c.column_name = ty.column_name GROUP BY c.column_name) k ON t.column_name = k.column_name
LEFT JOIN ({_numeric()}) n ON t.column_name = n.column_name"""


def _numeric() -> str:
    return f"""SELECT c.column_name, CAST(min({_NUM}) AS DOUBLE) AS min_value, CAST(max({_NUM}) AS DOUBLE) AS max_value,
  CAST(sum({_NUM}) AS DOUBLE) AS sum_value, round(CAST(sum({_NUM}) AS DOUBLE) / count({_NUM}) * 1e6) / 1e6 AS mean_value,
  count(*) FILTER (WHERE {_NUM} = 0) AS zero_count, count(*) FILTER (WHERE {_NUM} < 0) AS negative_count,
  count(*) FILTER (WHERE regexp_matches(v, '[$€£¥₹,]')) AS marker_count
FROM cells c JOIN types t ON c.column_name = t.column_name WHERE semantic_type IN ('integer', 'decimal', 'currency_string') GROUP BY c.column_name"""


def _head(name: str) -> str:
    return f"WITH {_cells(name)}, {EVIDENCE}, {TYPES} "


def _counts(w, name="transactions"):
    """The counted values of a dataset, folded and written once per workspace."""
    kept = w.__dict__.setdefault("_value_counts", {})
    if name not in kept:
        kept[name] = written(P.value_counts(w.raw[name], SETS[name]), f"counts-{name}")
    return kept[name]


def _types(w, name="transactions"):
    return P.infer_semantic_type(P.type_evidence(_counts(w, name), CONFIG))


_PAYLOAD = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _keyed_lines(spark, sf_dir):
    """Line items under the key (order, line number), which several lines share."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"), *_PAYLOAD)


_DIFFER = ", ".join(f"CASE WHEN count(DISTINCT {c}) > 1 THEN '{c}' END" for c in _PAYLOAD)
_LINES = f"""lines AS (SELECT l_orderkey || '-' || l_linenumber AS line_id, {', '.join(_PAYLOAD)} FROM lineitem),
groups AS (SELECT line_id, count(*) AS row_count, count(DISTINCT ({', '.join(_PAYLOAD)})) AS distinct_row_count,
  concat_ws(',', {_DIFFER}) AS differing_columns FROM lines GROUP BY line_id)"""


def _samples(spark, sf_dir):
    people = parquet_with_row_place(spark, f"{sf_dir}/customer.parquet", "source_row")
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    people = people.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)"))
    return P.sample_values(people, columns, people.count())


def _rule_table(w):
    """The money columns and, so that there are many, small multiples of the quantity."""
    multiples = [(F.col("quantity") * n).alias(f"quantity_{n}") for n in range(2, 9)]
    wide = w.sales.select("quantity", "unit_price", "extended_amount", "total_amount", "discount_amount", *multiples)
    return wide.select(*[F.col(c).cast("string").alias(c) for c in _PAIRS])


_PAIRS = ["quantity", "unit_price", "extended_amount", "total_amount", "discount_amount", *[f"quantity_{n}" for n in range(2, 9)]]


def _rules() -> str:
    """All pairs and targets of every row at once, from rows of (row, column, value)."""
    columns = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _PAIRS)
    multiples = ", ".join(f"quantity * {n} AS quantity_{n}" for n in range(2, 9))
    tests = ", ".join(f"count(*) FILTER (WHERE a.value * b.value IS NOT NULL AND w.{t} IS NOT NULL) AS c_{t}, count(*) FILTER (WHERE abs(a.value * b.value - w.{t}) <= 0.01) AS m_{t}" for t in _PAIRS)
    rows = " UNION ALL ".join(f"SELECT f1, f2, '{t}' AS target, c_{t} AS comparable_row_count, m_{t} AS match_count FROM counted WHERE '{t}' NOT IN (f1, f2)" for t in _PAIRS)
    return f"""WITH wide AS (SELECT row_number() OVER () AS id, {columns} FROM (SELECT *, {multiples} FROM sales)),
long AS (UNPIVOT wide ON {', '.join(_PAIRS)} INTO NAME name VALUE value),
counted AS (SELECT a.name AS f1, b.name AS f2, {tests} FROM long a JOIN long b ON a.id = b.id AND a.name < b.name JOIN wide w ON w.id = a.id GROUP BY 1, 2),
rules AS ({rows})
SELECT target || ' ~= ' || f1 || ' * ' || f2 AS relationship, *  EXCLUDE (f1, f2), round(match_count * 1e6 / comparable_row_count) / 1e6 AS match_rate
FROM rules WHERE match_count * 2 >= comparable_row_count AND comparable_row_count > 0"""


def _everywhere(name, build, sql) -> Query:
    """A query over all three tables, one under the other."""
    return Query(name, on_feed(lambda w: reduce(DataFrame.unionByName, [build(w, n).withColumn("dataset", F.lit(n)) for n in SETS])),
                 over(" UNION ALL BY NAME ".join(f"SELECT *, '{n}' AS dataset FROM ({sql(n)})" for n in SETS), *[f"raw_{n}" for n in SETS]))


def _sketched(w, n):
    """Sketches of seven parts of a table, merged, against the exact counts."""
    parts = written(P.distinct_sketches(w.raw[n], SETS[n], F.col("source_row") % 7), f"sketches-{n}")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 4 * P.SKETCH_ERROR * F.col("distinct_count") + 1
    return P.approximate_distinct(parts).join(P.profile_distinct(_counts(w, n)), "column_name").select(
        "column_name", "cells", "distinct_count", near.alias("within_error"))


def _dates(w, n):
    return _types(w, n).filter("semantic_type = 'date'").select("column_name")


def _date_report(w, n):
    """The report over the date columns, examples as texts."""
    typed = written(_dates(w, n), f"dates-{n}")
    report = P.date_format_report(_counts(w, n).join(F.broadcast(typed), "column_name"), CONFIG, w.raw[n])
    return report.withColumns({f"{kind}_examples": F.concat_ws("|", f"{kind}_examples") for kind in P.DATE_KINDS})


def _date_examples(w, n):
    found = [P.date_examples(w.raw[n], r.column_name, CONFIG).withColumn("column_name", F.lit(r.column_name)) for r in _dates(w, n).collect()]
    none = w.spark.createDataFrame([], "source_row long, token string, example_kind string, example_rank int, column_name string")
    return reduce(DataFrame.unionByName, found, none)


_READ = r""", read AS (SELECT c.column_name, source_row, v, CASE WHEN regexp_full_match(v, '\d{4}-\d{1,2}-\d{1,2}') THEN '%Y-%m-%d'
    WHEN regexp_full_match(v, '\d{1,2}/\d{1,2}/\d{4}') THEN '%m/%d/%Y' WHEN regexp_full_match(v, '\d{1,2}-\d{1,2}-\d{4}') THEN '%d-%m-%Y' END AS f
  FROM cells c JOIN types t ON c.column_name = t.column_name WHERE semantic_type = 'date'),
days AS (SELECT *, CASE WHEN day IS NOT NULL THEN f END AS fmt FROM (SELECT *, CAST(try_strptime(v, ['%Y-%m-%d', '%m/%d/%Y', '%d-%m-%Y']) AS DATE) AS day FROM read))"""


def _report(w):
    """The report of every table: its columns with their sections, as counts and texts."""
    def one(n):
        parents = {"store_id": (w.stores, "store_id")} if n == "transactions" else None
        r = P.profile_report(w.raw[n], n, CONFIG, parents)
        whole = r["dataset"].select("dataset", F.col("row_count").alias("table_rows"), "duplicate_rows")
        return r["columns"].join(whole, "dataset").select(
            "dataset", "column_name", "semantic_type", "table_rows", "duplicate_rows", "distinct_count", "null_count",
            "lengths.min_length", "lengths.max_length", F.concat_ws(",", F.col("lengths.histogram.chars").cast("array<string>")).alias("common_lengths"),
            F.concat_ws("|", F.transform("top_values", lambda t: F.coalesce(t["value"], F.lit("")))).alias("top_values"),
            F.size("samples").alias("samples"), F.coalesce(F.size("failures"), F.lit(0)).alias("failure_examples"),
            "evidence.distinct_tokens", F.coalesce("dates.observable_count", F.lit(0)).alias("dates_read"))
    return reduce(DataFrame.unionByName, P.side_by_side(w.spark, list(SETS), one))


def _report_sql(n: str) -> str:
    return _head(n) + f""", lens AS (SELECT column_name, length(v) AS chars, count(*) AS k FROM cells WHERE v IS NOT NULL GROUP BY 1, 2),
lent AS (SELECT column_name, min(lo) AS min_length, max(hi) AS max_length, string_agg(CAST(chars AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 10) AS common_lengths
  FROM (SELECT *, min(chars) OVER p AS lo, max(chars) OVER p AS hi, row_number() OVER (PARTITION BY column_name ORDER BY k DESC, chars) AS place FROM lens WINDOW p AS (PARTITION BY column_name)) GROUP BY 1),
tops AS (SELECT column_name, string_agg(coalesce(v, ''), '|' ORDER BY place) AS top_values FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k DESC, v NULLS LAST) AS place FROM (SELECT column_name, v, count(*) AS k FROM cells GROUP BY 1, 2)) WHERE place <= 5 GROUP BY 1),
bad AS (SELECT c.column_name, count(*) AS fails FROM cells c JOIN types t ON c.column_name = t.column_name WHERE v IS NOT NULL AND {_BAD} GROUP BY 1),
own AS (SELECT column_name, count(DISTINCT v) AS distinct_count, count(*) - count(v) AS null_count FROM cells GROUP BY 1)
SELECT '{n}' AS dataset, t.column_name, semantic_type, (SELECT count(*) FROM raw_{n}) AS table_rows,
  (SELECT CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM raw_{n} GROUP BY {', '.join(SETS[n])})) AS duplicate_rows, distinct_count, null_count,
  CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length, common_lengths, top_values,
  CAST(least(5, (SELECT count(*) FROM raw_{n})) AS INTEGER) AS samples, CAST(least(5, coalesce(fails, 0)) AS INTEGER) AS failure_examples, distinct_tokens,
  CASE WHEN semantic_type = 'date' THEN observable_count ELSE 0 END AS dates_read
FROM types t JOIN own USING (column_name) JOIN lent USING (column_name) JOIN tops USING (column_name) LEFT JOIN bad USING (column_name)"""


QUERIES = [
    Query("profile_missingness", on_feed(lambda w: reduce(DataFrame.unionByName, [
        P.profile_missingness(w.raw[n], SETS[n]).withColumn("dataset", F.lit(n)) for n in SETS])),
          over("SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM (WITH {_cells(n)} SELECT '{n}' AS dataset, column_name, count(*) AS row_count, count(*) - count(v) AS null_count, count(*) FILTER (WHERE trim(v) = '') AS blank_count, count(v) AS non_null_count, {_pct('(count(*) - count(v))', 'count(*)')} AS null_pct FROM cells GROUP BY column_name)" for n in SETS) + ")", *[f"raw_{n}" for n in SETS])),
    _everywhere("profile_distinct", lambda w, n: P.profile_distinct(_counts(w, n)), lambda n: f"WITH {_cells(n)} SELECT column_name, count(DISTINCT v) AS distinct_count, {_pct('count(DISTINCT v)', 'count(*)')} AS distinct_pct, count(DISTINCT v) = count(*) AS is_unique, count(DISTINCT v) = 1 AS is_constant FROM cells GROUP BY column_name"),
    _everywhere("approximate_distinct", _sketched, lambda n: f"WITH {_cells(n)} SELECT column_name, count(v) AS cells, count(DISTINCT v) AS distinct_count, TRUE AS within_error FROM cells GROUP BY column_name"),
    _everywhere("duplicate_rows", lambda w, n: P.duplicate_rows(w.raw[n], SETS[n]), lambda n: f"SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {_pct('sum(n - 1)', 'sum(n)')} AS duplicate_pct FROM (SELECT count(*) AS n FROM raw_{n} GROUP BY {', '.join(SETS[n])})"),
    _everywhere("length_histogram", lambda w, n: P.length_histogram(_counts(w, n)), lambda n: f"""WITH {_cells(n)}, l AS (SELECT column_name, CAST(length(v) AS INTEGER) AS chars, count(*) AS cells FROM cells WHERE v IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, min(chars) OVER (PARTITION BY column_name) AS min_chars, max(chars) OVER (PARTITION BY column_name) AS max_chars,
  row_number() OVER (PARTITION BY column_name ORDER BY cells DESC, chars) AS length_rank FROM l)
SELECT column_name, chars, cells, min_chars, max_chars, CAST(length_rank AS INTEGER) AS length_rank FROM r WHERE length_rank <= 10"""),
    _everywhere("top_values", lambda w, n: P.top_values(_counts(w, n)), lambda n: f"""WITH {_cells(n)}, n AS (SELECT column_name, v AS value, count(*) AS cells FROM cells GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cells DESC, value NULLS LAST) AS value_rank, sum(cells) OVER (PARTITION BY column_name) AS every,
  count(value) OVER (PARTITION BY column_name) AS kinds FROM n)
SELECT column_name, CAST(value_rank AS INTEGER) AS value_rank, value, cells, {_pct('cells', 'every')} AS pct FROM r WHERE kinds >= 1 AND value_rank <= 5"""),
    Query("sample_values", _samples,
          """WITH p AS (SELECT *, row_number() OVER () - 1 AS source_row, count(*) OVER () AS n FROM customer),
spots AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) AS place FROM (SELECT DISTINCT n FROM p), (VALUES (0), (1), (2), (3), (4)) AS k(i))
SELECT source_row, 'c_custkey' AS column_name, CAST(c_custkey AS VARCHAR) AS value FROM p WHERE source_row IN (SELECT place FROM spots)
UNION ALL SELECT source_row, 'c_name', c_name FROM p WHERE source_row IN (SELECT place FROM spots)
UNION ALL SELECT source_row, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM p WHERE source_row IN (SELECT place FROM spots)
UNION ALL SELECT source_row, 'c_acctbal', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) FROM p WHERE source_row IN (SELECT place FROM spots)
UNION ALL SELECT source_row, 'c_mktsegment', c_mktsegment FROM p WHERE source_row IN (SELECT place FROM spots)"""),
    _everywhere("type_evidence", lambda w, n: P.type_evidence(_counts(w, n), CONFIG), lambda n: _head(n) + "SELECT * EXCLUDE (position) FROM evidence"),
    Query("infer_semantic_type", on_feed(lambda w: _types(w).unionByName(_types(w, "products")).unionByName(_types(w, "stores")).select("column_name", "observable_count", "semantic_type", "confidence")),
          over("SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_head(n)} SELECT column_name, observable_count, semantic_type, confidence FROM trusted)" for n in SETS) + ")",
               "raw_transactions", "raw_products", "raw_stores")),
    _everywhere("parse_failures", lambda w, n: P.parse_failures(_counts(w, n), _types(w, n), CONFIG), lambda n: _head(n) + f"SELECT c.column_name, semantic_type, count(*) FILTER (WHERE {_BAD}) AS parse_failure_count FROM cells c JOIN types t ON c.column_name = t.column_name WHERE v IS NOT NULL GROUP BY 1, 2"),
    _everywhere("parse_failure_examples", lambda w, n: P.parse_failure_examples(w.raw[n], SETS[n], _types(w, n), CONFIG), lambda n: _head(n) + f""", bad AS (SELECT c.column_name, source_row, v AS token, row_number() OVER (PARTITION BY c.column_name ORDER BY source_row) AS example_rank
  FROM cells c JOIN types t ON c.column_name = t.column_name WHERE v IS NOT NULL AND {_BAD})
SELECT column_name, CAST(example_rank AS INTEGER) AS example_rank, source_row, token FROM bad WHERE example_rank <= 5""".lstrip()),
    _everywhere("numeric_stats", lambda w, n: P.numeric_stats(_counts(w, n), _types(w, n)).drop("parsed_count"), lambda n: _head(n) + _numeric()),
    _everywhere("date_format_report", _date_report, lambda n: _head(n) + _READ + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY column_name, v IS NOT NULL AND day IS NULL ORDER BY source_row) AS u, row_number() OVER (PARTITION BY column_name, coalesce(day > {AS_OF}, FALSE) ORDER BY source_row) AS a FROM days)
SELECT column_name, count(v) AS observable_count,
  '{{"%Y-%m-%d":' || count(*) FILTER (WHERE fmt = '%Y-%m-%d') || ',"%m/%d/%Y":' || count(*) FILTER (WHERE fmt = '%m/%d/%Y') || ',"%d-%m-%Y":' || count(*) FILTER (WHERE fmt = '%d-%m-%Y') || '}}' AS format_histogram,
  CAST(count(DISTINCT fmt) AS INTEGER) AS distinct_format_count, mode(fmt) AS dominant_format,
  {_pct("count(*) FILTER (WHERE fmt = '%Y-%m-%d')", 'count(v)')} AS dominant_coverage, count(v) - count(*) FILTER (WHERE fmt = '%Y-%m-%d') AS rows_lost_to_single_format,
  count(v) - count(day) AS unmatched_count, CAST(0 AS BIGINT) AS ambiguous_count, min(day) AS min_date, max(day) AS max_date,
  count(*) FILTER (WHERE day > {AS_OF}) AS after_as_of_count,
  coalesce(string_agg(v, '|' ORDER BY source_row) FILTER (WHERE v IS NOT NULL AND day IS NULL AND u <= 5), '') AS unmatched_examples, '' AS ambiguous_examples,
  coalesce(string_agg(v, '|' ORDER BY source_row) FILTER (WHERE day > {AS_OF} AND a <= 5), '') AS after_as_of_examples FROM numbered GROUP BY column_name"""),
    _everywhere("date_examples", _date_examples, lambda n: _head(n) + _READ + f""",
kinds AS (SELECT column_name, source_row, v AS token, CASE WHEN day IS NULL THEN 'unmatched' WHEN day > {AS_OF} THEN 'after_as_of' END AS example_kind FROM days WHERE v IS NOT NULL)
SELECT *, CAST(row_number() OVER (PARTITION BY column_name, example_kind ORDER BY source_row) AS INTEGER) AS example_rank FROM kinds WHERE example_kind IS NOT NULL QUALIFY example_rank <= 5"""),
    Query("candidate_keys", on_feed(lambda w: P.candidate_keys(P.column_profile(w.raw["transactions"], TX, CONFIG))),
          over(_head("transactions") + f""", p AS ({_one_profile('transactions')})
SELECT CAST(row_number() OVER (ORDER BY distinct_pct DESC, position) AS INTEGER) AS key_rank, column_name, semantic_type, distinct_pct, is_unique FROM p WHERE semantic_type = 'identifier' OR is_unique""".lstrip(), "raw_transactions")),
    Query("pk_uniqueness", lambda spark, d: P.pk_uniqueness(_keyed_lines(spark, d), "line_id"),
          f"""WITH {_LINES} SELECT count(*) AS distinct_key_count, count(*) FILTER (WHERE row_count > 1) AS duplicate_key_count,
  CAST(coalesce(sum(row_count) FILTER (WHERE row_count > 1), 0) AS BIGINT) AS duplicated_row_count,
  count(*) FILTER (WHERE row_count > 1 AND distinct_row_count = 1) AS exact_duplicate_key_count,
  CAST(coalesce(sum(row_count - 1) FILTER (WHERE row_count > 1 AND distinct_row_count = 1), 0) AS BIGINT) AS exact_duplicate_row_count,
  count(*) FILTER (WHERE distinct_row_count > 1) AS conflicting_key_count, CAST(0 AS BIGINT) AS null_key_count, count(*) FILTER (WHERE row_count > 1) = 0 AS is_unique FROM groups"""),
    Query("pk_conflicts", lambda spark, d: P.pk_conflicts(_keyed_lines(spark, d), "line_id"),
          f"WITH {_LINES} SELECT line_id AS key_value, row_count, distinct_row_count, differing_columns FROM groups WHERE distinct_row_count > 1"),
    Query("pk_conflict_values", on_feed(lambda w: P.pk_conflict_values(w.raw["products"], "product_id").unionByName(P.pk_conflict_values(w.raw["stores"], "store_id"))),
          over(" UNION ALL ".join(
              f"SELECT DISTINCT {key} AS key_value, '{c}' AS column_name, {c} AS value FROM raw_{n} WHERE {key} IN (SELECT {key} FROM raw_{n} GROUP BY {key} HAVING count(DISTINCT coalesce({c}, '~none~')) > 1)"
              for n, key in (("products", "product_id"), ("stores", "store_id")) for c in SETS[n] if c != key), "raw_products", "raw_stores")),
    Query("referential_integrity", on_feed(lambda w: P.referential_integrity(w.raw_rows, "store_id", w.stores, "store_id").withColumn("relation", F.lit("store")).unionByName(
        P.referential_integrity(w.raw_rows, "customer_id", X.customers(w.sales, CONFIG), "customer_id").withColumn("relation", F.lit("customer")))),
          over(" UNION ALL ".join(f"""SELECT count(*) AS child_row_count, count(*) - count(c.{k}) AS null_key_count, (SELECT count(*) FROM {p}) AS parent_key_count,
  count(*) FILTER (WHERE c.{k} NOT IN (SELECT {k} FROM {p})) AS orphan_row_count, count(DISTINCT c.{k}) FILTER (WHERE c.{k} NOT IN (SELECT {k} FROM {p})) AS orphan_key_count,
  {_pct(f'count(*) FILTER (WHERE c.{k} NOT IN (SELECT {k} FROM {p}))', 'count(*)')} AS orphan_rate,
  (SELECT count(*) FROM {p} WHERE {k} NOT IN (SELECT {k} FROM raw_transactions WHERE {k} IS NOT NULL)) AS unreferenced_parent_count,
  coalesce((SELECT string_agg({k}, ',' ORDER BY {k}) FROM (SELECT DISTINCT {k} FROM raw_transactions WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {k} FROM {p}) ORDER BY {k} LIMIT 25)), '') AS orphan_keys,
  coalesce((SELECT string_agg({k}, ',' ORDER BY {k}) FROM (SELECT {k} FROM {p} WHERE {k} NOT IN (SELECT {k} FROM raw_transactions WHERE {k} IS NOT NULL) ORDER BY {k} LIMIT 25)), '') AS unreferenced_parent_keys,
  count(DISTINCT c.{k}) FILTER (WHERE c.{k} NOT IN (SELECT {k} FROM {p})) > 25 AS orphan_keys_truncated,
  (SELECT count(*) FROM {p} WHERE {k} NOT IN (SELECT {k} FROM raw_transactions WHERE {k} IS NOT NULL)) > 25 AS unreferenced_parent_keys_truncated,
  '{r}' AS relation FROM raw_transactions c""" for k, p, r in (("store_id", "stores_clean", "store"), ("customer_id", "dim_customer", "customer"))), "stores_clean", "dim_customer")),
    Query("arithmetic_reconciliation", on_feed(lambda w: P.arithmetic_reconciliation(w.raw["transactions"], "total_amount", ("quantity", "unit_price"))),
          over("""WITH d AS (SELECT extended, extended - total AS delta FROM flagged)
SELECT count(delta) AS comparable_row_count, count(*) - count(delta) AS unparseable_row_count, count(*) FILTER (WHERE abs(delta) <= 0.01) AS match_count,
  count(*) FILTER (WHERE abs(delta) > 0.01) AS mismatch_count, CAST(sum(delta) FILTER (WHERE abs(delta) > 0.01) AS DOUBLE) AS total_signed_delta,
  CAST(sum(abs(delta)) FILTER (WHERE abs(delta) > 0.01) AS DOUBLE) AS total_absolute_delta, CAST(max(abs(delta)) AS DOUBLE) AS max_absolute_delta,
  round(avg(abs(CAST(delta AS DOUBLE) / nullif(CAST(extended AS DOUBLE), 0))) FILTER (WHERE abs(delta) > 0.01) * 1e6) / 1e6 AS mean_relative_delta,
  round(count(*) FILTER (WHERE abs(delta) <= 0.01) * 1e6 / count(delta)) / 1e6 AS match_rate FROM d""", "flagged")),
    Query("reconciliation_examples", on_feed(lambda w: P.reconciliation_examples(w.raw["transactions"], "total_amount", ("quantity", "unit_price")).withColumns(
        {c: F.round(F.col(c) * 100) / 100 for c in ("reported", "computed", "delta")})),
          over("""SELECT source_row, CAST(total AS DOUBLE) AS reported, CAST(extended AS DOUBLE) AS computed, CAST(extended - total AS DOUBLE) AS delta,
  quantity AS factor_quantity, unit_price AS factor_unit_price FROM flagged WHERE abs(extended - total) > 0.01 ORDER BY source_row LIMIT 10""", "flagged")),
    Query("discover_relationships", on_feed(lambda w: P.discover_relationships(_rule_table(w), _PAIRS)), over(_rules(), "sales")),
    Query("profile_report", on_feed(_report), over(" UNION ALL BY NAME ".join(f"SELECT * FROM ({_report_sql(n)})" for n in SETS), *[f"raw_{n}" for n in SETS])),
    Query("profile_datasets", on_feed(lambda w: P.profile_datasets(w.raw, CONFIG)),
          over(" UNION ALL BY NAME ".join(f"SELECT * FROM ({_head(n)} {_one_profile(n)})" for n in SETS), "raw_transactions", "raw_products", "raw_stores")),
]
