"""Missing values, trimming, shapes and row signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# White space in the sense of the feed, including the no-break space.
BLANK = r"^[\s\p{Z}]*$"
TRIMMED = (
    " \t\n\r\f\v\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9]*[-_]?\d+$"

# Cell texts a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def is_missing(c: Column) -> Column:
    """Null, or text with nothing but white space."""
    return c.isNull() | c.rlike(BLANK)


def is_missing_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def is_blank_string(c: Column) -> Column:
    """Present but empty; null is not blank."""
    return F.coalesce(c.rlike(BLANK), F.lit(False))


def trimmed(c: Column) -> Column:
    """Text without outer white space. Parsers build on this: it names its input only once, so
    their expressions stay small however they nest."""
    return F.btrim(c, F.lit(TRIMMED))


def normalise_text(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def matched(c: Column, pattern: str) -> Column:
    """The text when it matches the whole pattern, else null; one regex pass, one reference."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0))


def code_list(*codes: Column) -> Column:
    """Comma-joined codes, nulls left out."""
    return F.concat_ws(",", *codes)


def explode_codes(df: DataFrame, codes: Column, name: str) -> DataFrame:
    """One row per code of a comma-joined list; rows without a code vanish."""
    return df.filter(codes != "").withColumn(name, F.explode(F.split(codes, ",")))


def normalise_frame(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    return df.withColumns({name: normalise_text(F.col(name)) for name in columns})


def tokens_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def row_signature(columns: list[str] | tuple[str, ...]) -> Column:
    """The whole raw row as one text: fields split by unit separator, null as NUL."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x00")) for c in columns])


def is_identifier(c: Column) -> Column:
    return F.coalesce(c.rlike(IDENTIFIER), F.lit(False))


def identifier_rate(c: Column) -> Column:
    """Aggregate: share of observable values shaped like a business key."""
    token = normalise_text(c)
    return F.coalesce(F.avg(token.rlike(IDENTIFIER).cast("double")), F.lit(0.0))
