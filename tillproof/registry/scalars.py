"""Registered queries for the column functions: whole tables, one output row per input row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillproof.functions import codes, dates, money, text
from tillproof.registry.base import MESSY_SQL, Query, messy, on_feed, table
from tillproof.registry.oracle import over
from tillproof.schemas import RAW_COLUMNS


def _m(columns):
    """Columns over the odd texts; built when the query runs, for they need a session."""
    return lambda spark, sf_dir: messy(spark, sf_dir).select("id", *[c.alias(n) for n, c in columns().items()])


def _s(body: str) -> str:
    return f"WITH {MESSY_SQL} SELECT id, {body} FROM messy"


def _iso(spark, sf_dir):
    df = messy(spark, sf_dir)
    fine = df.withColumn("d", F.when(df.id % 11 == 0, df.date_text).when(df.id % 11 == 7, F.lit("NaT")))
    return fine.select("id", dates.to_iso_date(F.col("d")).alias("iso"))


NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"
_AMOUNT = r"""replace(replace(replace(replace(replace(
  CASE WHEN trim(amount_text) LIKE '(%)' THEN substr(trim(amount_text), 2, length(trim(amount_text)) - 2)
       ELSE trim(amount_text) END, '$', ''), 'USD', ''), ',', ''), ' ', ''), '""" + "−" + "', '-')"
_MONEY = (f"CASE WHEN regexp_full_match({_AMOUNT}, '{NUMBER}') THEN CAST(ltrim({_AMOUNT}, '+') AS DECIMAL(18,2))"
          " * CASE WHEN trim(amount_text) LIKE '(%)' THEN -1 ELSE 1 END END")
_DAY = r"""CASE
  WHEN regexp_full_match(trim(date_text), '\d{4}-\d{1,2}-\d{1,2}') THEN CAST(try_strptime(trim(date_text), '%Y-%m-%d') AS DATE)
  WHEN regexp_full_match(trim(date_text), '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(trim(date_text), '%m/%d/%Y') AS DATE)
  WHEN regexp_full_match(trim(date_text), '\d{1,2}-\d{1,2}-\d{4}') THEN CAST(try_strptime(trim(date_text), '%d-%m-%Y') AS DATE) END"""
_OTHER = r"""CASE
  WHEN regexp_full_match(trim(date_text), '\d{1,2}/\d{1,2}/\d{4}') THEN CAST(try_strptime(trim(date_text), '%d/%m/%Y') AS DATE)
  WHEN regexp_full_match(trim(date_text), '\d{1,2}-\d{1,2}-\d{4}') THEN CAST(try_strptime(trim(date_text), '%m-%d-%Y') AS DATE) END"""
_FMT = f"""CASE WHEN ({_DAY}) IS NULL THEN NULL WHEN date_text LIKE '%/%' THEN '%m/%d/%Y'
  WHEN substr(trim(date_text), 5, 1) = '-' THEN '%Y-%m-%d' ELSE '%d-%m-%Y' END"""
_SWAP = f"(({_DAY}) IS NOT NULL AND ({_OTHER}) IS NOT NULL AND ({_DAY}) <> ({_OTHER}))"


QUERIES = [
    Query("is_missing", _m(lambda: dict(text_missing=text.is_missing(F.col("name_text")), amount_missing=text.is_missing(F.col("amount_text")))),
          _s("name_text IS NULL OR trim(name_text) = '' AS text_missing, amount_text IS NULL OR trim(amount_text) = '' AS amount_missing")),
    Query("is_blank_string", _m(lambda: dict(blank=text.is_blank_string(F.col("name_text")))),
          _s("coalesce(trim(name_text) = '', FALSE) AS blank")),
    Query("normalise_text", lambda spark, d: text.normalise_frame(
        messy(spark, d).select("id", "name_text", "amount_text"), ["name_text", "amount_text"]),
          _s("nullif(trim(name_text), '') AS name_text, nullif(trim(amount_text), '') AS amount_text")),
    Query("parse_date_multiformat", lambda spark, d: dates.with_date_reading(messy(spark, d), "date_text").select(
        "id", "date_text", "parsed_date", "date_format", "needed_non_iso", "date_is_ambiguous",
        (F.col("date_format") == "%Y-%m-%d").alias("is_iso")),
          _s(f"date_text, {_DAY} AS parsed_date, {_FMT} AS date_format, coalesce(({_FMT}) <> '%Y-%m-%d', FALSE) AS needed_non_iso,"
             f" {_SWAP} AS date_is_ambiguous, ({_FMT}) = '%Y-%m-%d' AS is_iso")),
    Query("date_ambiguity", _m(lambda: dict(
        swapped_format=dates.date_ambiguity(F.col("date_text"))["swapped_format"],
        swapped_date=dates.date_ambiguity(F.col("date_text"))["swapped_date"])),
          _s(f"CASE WHEN {_SWAP} THEN CASE WHEN date_text LIKE '%/%' THEN '%d/%m/%Y' ELSE '%m-%d-%Y' END END AS swapped_format,"
             f" CASE WHEN {_SWAP} THEN {_OTHER} END AS swapped_date")),
    Query("all_matching_formats", _m(lambda: dict(formats=F.concat_ws(",", dates.all_matching_formats(F.col("date_text"))))),
          _s(f"coalesce({_FMT}, '') AS formats")),
    Query("is_currency_formatted", _m(lambda: dict(formatted=money.is_currency_formatted(F.col("amount_text")))),
          _s(r"coalesce(trim(amount_text) <> '' AND NOT regexp_full_match(trim(amount_text), '[+-]?\d+(\.\d+)?'), FALSE) AS formatted")),
    Query("parse_currency", _m(lambda: dict(
        amount_text=F.col("amount_text"), amount=money.parse_currency(F.col("amount_text")).cast("double"),
        parse_failed=money.currency_parse_failed(F.col("amount_text")))),
          _s(f"amount_text, CAST({_MONEY} AS DOUBLE) AS amount,"
             f" coalesce(trim(amount_text) <> '', FALSE) AND ({_MONEY}) IS NULL AS parse_failed")),
    Query("parse_price", on_feed(lambda w: w.raw["products"].select(
        "source_row", money.parse_price(F.col("unit_price"), F.col("product_id")).cast("double").alias("price"))),
          over("SELECT source_row, CAST(price AS DOUBLE) AS price FROM priced_products", "settled_products")),
    Query("strip_currency", _m(lambda: dict(
        stripped=money.strip_currency(F.col("amount_text")), marked=money.has_currency_marker(F.col("amount_text")),
        as_float=money.to_float(F.col("amount_text")))),
          f"""WITH {MESSY_SQL}, cut AS (SELECT id, amount_text,
  regexp_replace(replace(trim(amount_text), ' ', ''), '[$€£¥₹,()]', '', 'g') AS bare FROM messy),
  signed AS (SELECT *, CASE WHEN trim(amount_text) LIKE '(%)' THEN '-' || bare ELSE bare END AS stripped FROM cut)
SELECT id, stripped, coalesce(regexp_matches(amount_text, '[$€£¥₹,]'), FALSE) AS marked,
  CASE WHEN regexp_full_match(stripped, '{NUMBER}') THEN CAST(stripped AS DOUBLE) END AS as_float FROM signed"""),
    Query("coerce_int", _m(lambda: dict(
        int_text=F.col("int_text"), value=money.coerce_int(F.col("int_text")),
        parse_failed=money.int_parse_failed(F.col("int_text")))),
          f"""WITH {MESSY_SQL}, cut AS (SELECT id, int_text, TRY_CAST(replace(replace(trim(int_text), ',', ''), '−', '-') AS DOUBLE) AS v FROM messy)
SELECT id, int_text, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS value,
  int_text IS NOT NULL AND (v IS NULL OR v <> floor(v)) AS parse_failed FROM cut"""),
    Query("is_parseable", _m(lambda: dict(
        as_int=money.is_parseable_int(F.col("int_text")), as_decimal=money.is_parseable_decimal(F.col("amount_text")))),
          _s(r"coalesce(regexp_full_match(replace(trim(int_text), ',', ''), '[+-]?\d+'), FALSE) AS as_int,"
             f" coalesce(regexp_full_match(replace(trim(amount_text), ',', ''), '{NUMBER}'), FALSE) AS as_decimal")),
    Query("round_money", lambda spark, d: table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        money.round_money(F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("cents")),
          "SELECT l_orderkey, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))), 2) AS DOUBLE) AS cents FROM lineitem GROUP BY l_orderkey"),
    Query("reconcile_line", lambda spark, d: table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.reconcile_line(
            F.col("l_quantity").cast("int"), F.lit(1500).cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)")).alias("r")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("r.extended_amount").cast("double").alias("extended_amount"),
             F.col("r.discount_amount").cast("double").alias("discount_amount"), "r.has_discount", "r.discount_pct"),
          """WITH q AS (SELECT *, CAST(l_quantity AS INTEGER) * CAST(1500 AS DECIMAL(18,2)) AS e, CAST(l_extendedprice AS DECIMAL(18,2)) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(e AS DOUBLE) AS extended_amount, CAST(e - t AS DOUBLE) AS discount_amount,
  abs(e - t) > 0.01 AS has_discount, round(CAST(e - t AS DOUBLE) * 1e6 / nullif(CAST(e AS DOUBLE), 0)) / 1e6 AS discount_pct FROM q"""),
    Query("to_flag", _m(lambda: dict(flag=money.to_flag(F.col("flag_text")))),
          _s("CASE WHEN lower(flag_text) IN ('true','t','yes','y','1') THEN 1 ELSE 0 END AS flag")),
    Query("to_iso_date", _iso,
          _s("CASE WHEN id % 11 = 0 THEN date_text END AS iso")),
    Query("zip_pad_guarded", _m(lambda: dict(
        zip_text=F.col("zip_text"), zip_code=codes.zip_pad_guarded(F.col("zip_text")), suspect=codes.zip_is_suspect(F.col("zip_text")))),
          _s(r"""zip_text, CASE WHEN regexp_full_match(zip_text, '\d{1,5}') THEN repeat('0', 5 - length(zip_text)) || zip_text ELSE zip_text END AS zip_code,
  coalesce(NOT regexp_full_match(zip_text, '\d{5}'), FALSE) AS suspect""")),
    Query("row_signature", on_feed(lambda w: w.raw["transactions"].groupBy(
        text.row_signature(RAW_COLUMNS["transactions"]).alias("signature")).agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("copies").agg(F.count(F.lit(1)).alias("signatures"), F.sum(F.length("signature")).alias("total_length"))),
          over("""SELECT copies, count(*) AS signatures, CAST(sum(chars) AS BIGINT) AS total_length FROM (
  SELECT count(*) AS copies, any_value(length(transaction_id) + length(transaction_date) + length(store_id) + length(product_id)
    + coalesce(length(customer_id), 1) + length(quantity) + length(unit_price) + length(total_amount) + 7) AS chars
  FROM raw_transactions GROUP BY transaction_id, transaction_date, store_id, product_id, customer_id, quantity, unit_price, total_amount)
GROUP BY copies""", "raw_transactions")),
    Query("identifier_shape", lambda spark, d: messy(spark, d).groupBy((F.col("id") % 4).alias("form")).agg(
        F.count_if(text.is_identifier(F.col("id_text"))).alias("shaped"),
        text.identifier_rate(F.col("id_text")).alias("rate")),
          f"""WITH {MESSY_SQL} SELECT id % 4 AS form, count(*) FILTER (WHERE regexp_full_match(id_text, '[A-Za-z][A-Za-z0-9]*[-_]?\\d+')) AS shaped,
  avg(CASE WHEN regexp_full_match(id_text, '[A-Za-z][A-Za-z0-9]*[-_]?\\d+') THEN 1.0 ELSE 0.0 END) AS rate FROM messy GROUP BY 1"""),
    Query("safe_ratio", lambda spark, d: table(spark, d, "orders").select(
        "o_orderkey", money.ratio_or_zero(F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 7).cast("double")).alias("or_zero"),
        money.ratio_or_null(F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 7).cast("double")).alias("or_null")),
          """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE round(o_custkey * 1e6 / CAST(o_orderkey % 7 AS DOUBLE)) / 1e6 END AS or_zero,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey / CAST(o_orderkey % 7 AS DOUBLE) END AS or_null FROM orders"""),
    Query("mixed_sort_key", _m(lambda: dict(
        amount_number=codes.mixed_sort_key(F.col("amount_text"))["sort_number"], amount_word=codes.mixed_sort_key(F.col("amount_text"))["sort_text"],
        date_number=codes.mixed_sort_key(F.col("date_text"))["sort_number"], date_word=codes.mixed_sort_key(F.col("date_text"))["sort_text"])),
          f"""WITH {MESSY_SQL}, n AS (SELECT id, trim(amount_text) AS a, trim(date_text) AS t FROM messy),
k AS (SELECT *, CASE WHEN regexp_full_match(a, '-?[$€£]?\\s*-?[\\d,]+(\\.\\d+)?%?') THEN TRY_CAST(regexp_replace(a, '[$€£,%\\s]', '', 'g') AS DOUBLE) END AS an,
  CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr(t,1,10) AS DATE)
    WHEN regexp_full_match(t, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN CAST(try_strptime(t, '%m/%d/%Y') AS DATE)
    WHEN regexp_full_match(t, '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN CAST(try_strptime(t, '%d-%m-%Y') AS DATE) END AS td FROM n)
SELECT id, an AS amount_number, CASE WHEN an IS NULL AND a <> '' THEN lower(a) END AS amount_word,
  CAST(datediff('day', DATE '1970-01-01', td) AS DOUBLE) AS date_number, CASE WHEN td IS NULL AND t <> '' THEN lower(t) END AS date_word FROM k"""),
    Query("calendar_parts", lambda spark, d: table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select(
        "day", *[c.alias(n) for n, c in dates.calendar_parts(F.col("day")).items()]),
          """SELECT day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter,
  CAST(month(day) AS INTEGER) AS month, strftime(day, '%Y-%m') AS year_month, strftime(day, '%B') AS month_name, CAST(day(day) AS INTEGER) AS day_of_month,
  CAST(dayofweek(day) AS INTEGER) AS day_of_week, CAST(dayofweek(day) IN (0, 6) AS INTEGER) AS is_weekend
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"""),
]
