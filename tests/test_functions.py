import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillproof.functions import codes, dates, money, text

DAY = dt.date


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_missing_and_blank(spark):
    values = [None, "", "  ", " ", "x"]
    assert apply(spark, text.is_missing, values) == [True, True, True, True, False]
    assert apply(spark, text.is_blank_string, values) == [False, True, True, True, False]
    assert apply(spark, text.normalise_text, [" a b ", " ", " c\t"]) == ["a b", None, "c"]


def test_currency_never_becomes_zero(spark):
    cases = {
        "$1,234.50": Decimal("1234.50"), "(12.00)": Decimal("-12.00"), "(-12.00)": Decimal("-12.00"), "−5.25": Decimal("-5.25"), "USD 7": Decimal("7.00"),
        "+3.1": Decimal("3.10"), "1.005": Decimal("1.01"), " $ 4": Decimal("4.00"), "$ -9.99": Decimal("-9.99"),
        "nan": None, "inf": None, "N/A": None, "": None, "5d": None, "5f": None, "-": None, "--5": None, None: None}
    assert apply(spark, money.parse_currency, list(cases)) == list(cases.values())
    assert apply(spark, money.currency_parse_failed, ["x", " ", None, "1"]) == [True, False, False, False]


def test_currency_format_is_seen_on_text(spark):
    assert apply(spark, money.is_currency_formatted, ["$1", "1.50", "-3", "1,000", " ", None]) == [True, False, False, True, False, False]


def test_strip_currency_keeps_the_text(spark):
    assert apply(spark, money.strip_currency, ["($12.50)", "€ 3,000", "$ n/a", "(-1)"]) == ["-12.50", "3000", "n/a", "-1"]
    assert apply(spark, money.to_float, ["5.", ".5", "1e3", "1_0", "$2"]) == [5.0, 0.5, 1000.0, None, 2.0]


def test_integers(spark):
    values = ["3", "3.0", "2.7", "-4", "0", "1,200", "−8", "x", " ", None]
    assert apply(spark, money.coerce_int, values) == [3, 3, None, -4, 0, 1200, -8, None, None, None]
    assert apply(spark, money.int_parse_failed, values)[-5:] == [False, False, True, False, False]


def test_dates_by_ladder(spark):
    values = ["2026-05-15", "05/16/2026", "17-05-2026", "5/3/2026", "2026-02-30", "13/13/2026", "2026-05-15 x", None]
    assert apply(spark, dates.parsed_date, values) == [DAY(2026, 5, 15), DAY(2026, 5, 16), DAY(2026, 5, 17), DAY(2026, 5, 3), None, None, None, None]
    assert apply(spark, dates.date_format, values)[:4] == ["%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%m/%d/%Y"]


def test_ambiguity_needs_another_date(spark):
    got = apply(spark, lambda c: dates.date_ambiguity(c)["swapped_date"], ["03-05-2026", "17-05-2026", "05-05-2026", "2026-05-03"])
    assert got == [DAY(2026, 3, 5), None, None, None]


def test_price_that_cannot_be_read_stops(spark):
    assert apply(spark, lambda c: money.parse_price(c, F.lit("P1")), ["$1,000.5", "(3)", " ", None]) == [Decimal("1000.50"), Decimal("-3.00"), None, None]
    with pytest.raises(Exception, match="unreadable price"):
        apply(spark, lambda c: money.parse_price(c, F.lit("P1")), ["abc"])


def test_flags_and_iso(spark):
    assert apply(spark, money.to_flag, ["TRUE", "t", "0.0", "No"]) == [1, 1, 0, 0]
    for bad in ("maybe", None):
        with pytest.raises(Exception, match="not a flag"):
            apply(spark, money.to_flag, [bad])
    assert apply(spark, dates.to_iso_date, ["2026-05-03 10:00:00", "NaT", ""]) == ["2026-05-03", None, None]
    with pytest.raises(Exception, match="not a date"):
        apply(spark, dates.to_iso_date, ["soon"])


def test_zip_guard(spark):
    assert apply(spark, codes.zip_pad_guarded, ["14604", "0938", "N/A", "14604-1234", None]) == ["14604", "00938", "N/A", "14604-1234", None]
    assert apply(spark, codes.zip_is_suspect, ["14604", "0938", "N/A", "14604-1234", None]) == [False, True, True, True, False]


def test_signature_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    assert df.select(text.row_signature(["x", "y"]).alias("s")).distinct().count() == 2


def test_reconcile_keeps_total(spark):
    df = spark.createDataFrame([(3, Decimal("100.00"), Decimal("270.00")), (3, Decimal("1.00"), Decimal("2.99"))], "q int, p decimal(18,2), t decimal(18,2)")
    a, b = df.select(money.reconcile_line(F.col("q"), F.col("p"), F.col("t")).alias("r")).collect()
    assert (a.r.extended_amount, a.r.discount_amount, a.r.has_discount, a.r.discount_pct) == (Decimal("300.00"), Decimal("30.00"), True, 0.1)
    assert b.r.has_discount is False  # exactly one cent is inside the tolerance


def test_mixed_order_puts_blanks_last_both_ways(spark):
    values = ["$99.00", "$1,000.00", "", "05/01/2026", "apple", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    up = [r.v for r in df.orderBy(*codes.order_by_mixed(F.col("v"))).collect()]
    down = [r.v for r in df.orderBy(*codes.order_by_mixed(F.col("v"), False)).collect()]
    assert up[:4] == ["$99.00", "$1,000.00", "05/01/2026", "apple"]
    assert {up[-1], up[-2]} == {down[-1], down[-2]} == {"", None}


def test_weekday_starts_on_sunday(spark):
    row = spark.sql("select date'2026-05-31' d").select(*[c.alias(n) for n, c in dates.calendar_parts(F.col("d")).items()]).first()
    assert (row.date_key, row.day_of_week, row.is_weekend, row.year_month, row.month_name) == (20260531, 0, 1, "2026-05", "May")


def test_amounts_are_rounded_once(spark):
    texts = ["0.0049999999", "1.2249999996", "2.005", "-2.005", "1.004999999999999999999", "(0.0050000001)", "1e-3", "5e-3", "12345678901234.565"]
    want = ["0.00", "1.22", "2.01", "-2.01", "1.00", "-0.01", "0.00", "0.01", "12345678901234.57"]
    assert [str(v) for v in apply(spark, money.parse_currency, texts)] == want


def test_near_integers_are_no_integers(spark):
    values = ["2.0000001", "2.000000000000000000001", "2.000000000000000000000", ".0", "1e3", "1.5e1", "1e-3", "9007199254740993", "-0.0", "7."]
    assert apply(spark, money.coerce_int, values) == [None, None, 2, 0, 1000, 15, None, 9007199254740993, 0, 7]
