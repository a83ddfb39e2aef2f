"""Money, integers, flags and ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillproof.functions.text import matched, trimmed
from tillproof.schemas import MONEY

# Grammars of numbers.
BARE_DECIMAL = r"^[+-]?\d+(\.\d+)?$"
# A bare decimal that a plain cast to money reads without rounding or overflow.
CENTS = r"^[+-]?\d{1,15}(\.\d{1,2})?$"
INTEGER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
# Longest fraction read. Rounding half away from zero looks at one digit beyond the cents, so
# digits that are cut off here never change an amount.
FRACTION = 18
EXACT = f"decimal(38,{FRACTION})"
MINUS = "\u2212"
SPACES = " \u00a0"
CURRENCY_SYMBOLS = "$€£¥₹"
CURRENCY_MARK = "[$€£¥₹,]"
_CREDIT = "\x01"  # stands for an opening parenthesis while the text is cleaned


def round_money(c: Column) -> Column:
    """Cents, half away from zero, as an exact decimal."""
    return F.round(c, 2).cast(MONEY)


def exact_number(text: Column) -> Column:
    """Number text as a decimal that was not rounded; a longer fraction is cut, not rounded."""
    cut = F.regexp_replace(text, r"^([+-]?\d*\.\d{%d})\d+$" % FRACTION, "$1")
    return cut.try_cast(EXACT)


def is_currency_formatted(c: Column) -> Column:
    """Non-blank text that is not a bare decimal."""
    text = trimmed(c)
    return F.coalesce((text != "") & ~text.rlike(BARE_DECIMAL), F.lit(False))


def parse_currency(c: Column) -> Column:
    """Money text as decimal(18,2); blank and unreadable text give null, never zero.

    Only texts that match the number grammar are cast, so words such as nan or inf, which a
    plain cast would take for numbers, stay null.
    """
    text = trimmed(c)
    body = F.regexp_replace(text, r"^\((.*)\)$", _CREDIT + "$1")
    body = F.translate(F.regexp_replace(body, r"USD|usd|[$,\t \x{00A0}]", ""), MINUS, "-")
    body = F.regexp_replace(body, f"^{_CREDIT}[+-]?", "-")
    # Most cells are bare decimals and skip the cleaning; most of them are whole cents and skip the rounding.
    number = F.when(text.rlike(BARE_DECIMAL), text).otherwise(matched(body, DECIMAL))
    return F.when(text.rlike(CENTS), text.try_cast(MONEY)).otherwise(round_money(exact_number(number)))


def has_text(c: Column) -> Column:
    """Present and not blank."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def currency_parse_failed(c: Column) -> Column:
    return has_text(c) & parse_currency(c).isNull()


def parse_price(c: Column, who: Column) -> Column:
    """Catalogue price; blank gives null, unreadable text stops the job."""
    text = F.regexp_replace(F.regexp_replace(trimmed(c), r"[\s$,]", ""), r"^\((.*)\)$", "-$1")
    value = round_money(exact_number(matched(text, DECIMAL)))
    broken = F.raise_error(F.concat(F.lit("unreadable price of "), who, F.lit(": "), c)).cast(MONEY)
    return F.when(has_text(c), F.coalesce(value, broken))


def strip_currency(c: Column) -> Column:
    """Text without symbols, separators and spaces; parentheses become a minus."""
    body = F.regexp_replace(F.translate(trimmed(c), SPACES, ""), r"^\((.*)\)$", _CREDIT + "$1")
    body = F.translate(body, CURRENCY_SYMBOLS + ",", "")
    body = F.regexp_replace(body, f"^{_CREDIT}(?=$|-)", "")
    return F.translate(body, _CREDIT, "-")


def has_currency_marker(c: Column) -> Column:
    return F.coalesce(c.rlike(CURRENCY_MARK), F.lit(False))


def to_decimal(c: Column) -> Column:
    """Profiler number, exact; null when the stripped text is not a decimal."""
    return matched(strip_currency(c), DECIMAL).try_cast("decimal(28,6)")


def to_float(c: Column) -> Column:
    return matched(strip_currency(c), DECIMAL).try_cast("double")


def is_parseable_int(c: Column) -> Column:
    return F.coalesce(F.translate(trimmed(c), ",", "").rlike(INTEGER), F.lit(False))


def is_parseable_decimal(c: Column) -> Column:
    return F.coalesce(F.translate(trimmed(c), ",", "").rlike(DECIMAL), F.lit(False))


def coerce_int(c: Column) -> Column:
    """Signed integer; "3.0" is 3, "2.7" is null, sign and zero survive."""
    text = trimmed(c)
    number = matched(F.translate(text, MINUS + ",", "-"), DECIMAL)
    # A fraction is tested digit by digit, for a cast would round it away.
    plain = F.regexp_replace(matched(number, r"^[+-]?(\d+\.?0*|\.0+)$"), r"\.0*$", "")
    whole = F.when(plain.rlike(r"\d$"), plain).when(plain.isNotNull(), "0")
    powered = F.when(number.rlike("[eE]"), F.regexp_extract(number.try_cast(EXACT).cast("string"), r"^(-?\d+)\.0+$", 1))
    # Most cells are bare integers and skip the cleaning.
    return F.when(text.rlike(INTEGER), text.try_cast("long")).otherwise(F.coalesce(whole, powered).try_cast("long"))


def int_parse_failed(c: Column) -> Column:
    return has_text(c) & coerce_int(c).isNull()


def reconcile_line(quantity: Column, price: Column, total: Column, tolerance: float = 0.01) -> Column:
    """What the line should cost against what was charged. The charge is never changed."""
    extended = round_money(quantity * price)
    discount = round_money(extended - total)
    return F.struct(
        extended.alias("extended_amount"),
        discount.alias("discount_amount"),
        (F.abs(discount) > F.lit(tolerance).cast("decimal(18,6)")).alias("has_discount"),
        (F.round(F.try_divide(discount.cast("double") * 1e6, extended.cast("double"))) / 1e6)
        .alias("discount_pct"),
    )


def to_flag(c: Column) -> Column:
    """1 or 0 from the usual words; null or any other text stops the job."""
    text = F.lower(trimmed(c.cast("string")))
    return (
        F.when(text.isin("true", "t", "yes", "y", "1"), 1)
        .when(text.isin("false", "f", "no", "n", "0", "0.0"), 0)
        .otherwise(F.raise_error(
            F.concat(F.lit("not a flag: "), F.coalesce(text, F.lit("null")))).cast("int"))
    )


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """Six decimals; zero when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(top * 1e6, bottom)) / 1e6, F.lit(0.0))


def ratio_or_null(top: Column, bottom: Column) -> Column:
    return F.try_divide(top, bottom)
