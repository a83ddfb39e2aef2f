"""ZIP codes and typed sort keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillproof.functions.text import trimmed

FIVE_DIGITS = r"^\d{5}$"
SHORT_DIGITS = r"^\d{1,5}$"


def zip_is_suspect(c: Column) -> Column:
    return F.coalesce(~c.rlike(FIVE_DIGITS), F.lit(False))


def zip_pad_guarded(c: Column) -> Column:
    """Pad digit-only codes; leave every other text as it is (a bare lpad would cut ZIP+4)."""
    return F.when(c.rlike(SHORT_DIGITS), F.lpad(c, 5, "0")).otherwise(c)


# Number and date shapes of the mixed sort key.
_NUMBER = r"^-?[$€£]?\s*-?[\d,]+(\.\d+)?%?$"


def mixed_sort_key(c: Column) -> Column:
    """Struct(number, text): numbers and dates as numbers (dates in epoch days), else text."""
    text = trimmed(c)
    bare = F.regexp_replace(text, r"[$€£,%\s]", "")
    number = F.when(text.rlike(_NUMBER), bare.try_cast("double"))

    def day(shape: str, iso: str, part: Column) -> Column:
        ordered = F.regexp_replace(part, shape, iso).try_cast("date")
        return F.when(part.rlike(shape), F.unix_date(ordered).cast("double"))

    days = F.coalesce(
        day(r"^(\d{4})-(\d{2})-(\d{2})$", "$1-$2-$3", F.substring(text, 1, 10)),
        day(r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2", text),
        day(r"^(\d{2})-(\d{2})-(\d{4})$", "$3-$2-$1", text),
    )
    value = F.coalesce(number, days)
    return F.struct(
        value.alias("sort_number"),
        F.when(value.isNull() & (text != ""), F.lower(text)).alias("sort_text"),
    )


def order_by_mixed(c: Column, ascending: bool = True) -> list[Column]:
    """Sort columns: numbers first, then text, blanks last in both directions."""
    key = mixed_sort_key(c)
    blank = (key["sort_number"].isNull() & key["sort_text"].isNull()).asc()
    number, text = key["sort_number"], key["sort_text"]
    if ascending:
        return [blank, number.asc_nulls_last(), text.asc_nulls_last()]
    return [blank, number.desc_nulls_last(), text.desc_nulls_last()]
