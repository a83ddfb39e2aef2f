"""Date parsing over an ordered ladder of formats, and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.config import DATE_LADDER, DateRung
from tillproof.functions.text import trimmed

Ladder = tuple[DateRung, ...]


def _read(c: Column, shape: str, iso: str) -> Column:
    text = trimmed(c)
    ordered = text if iso == "$1-$2-$3" else F.regexp_replace(text, shape, iso)
    return F.when(text.rlike(shape), ordered.try_cast("date"))


def read_rung(c: Column, rung: DateRung) -> Column:
    """The date under one format. The shape test keeps a row from paying for casts that
    cannot succeed, and an impossible date gives null."""
    return _read(c, rung.shape, rung.iso)


def read_swapped(c: Column, rung: DateRung) -> Column:
    return _read(c, rung.shape, rung.swapped_iso)


def _first_label(readings: list[Column], ladder: Ladder) -> Column:
    return F.coalesce(*[F.when(d.isNotNull(), F.lit(r.label)) for d, r in zip(readings, ladder)])


def with_date_reading(df: DataFrame, column: str, ladder: Ladder = DATE_LADDER) -> DataFrame:
    """Add parsed_date, date_format, needed_non_iso and date_is_ambiguous.

    Each format is tried once per row in a first projection; the second only picks.
    """
    c = F.col(column)
    tried = {f"_d{i}": read_rung(c, r) for i, r in enumerate(ladder)}
    tried |= {f"_s{i}": read_swapped(c, r) for i, r in enumerate(ladder) if r.swapped_iso}
    own = [F.col(f"_d{i}") for i in range(len(ladder))]
    clash = [
        F.when(own[i].isNotNull(), F.coalesce(F.col(f"_s{i}") != own[i], F.lit(False)))
        if r.swapped_iso else F.when(own[i].isNotNull(), F.lit(False)) for i, r in enumerate(ladder)]
    out = df.withColumns(tried).withColumns({
        "parsed_date": F.coalesce(*own),
        "date_format": _first_label(own, ladder),
        "date_is_ambiguous": F.coalesce(*clash, F.lit(False)),
        "date_format_count": sum((d.isNotNull().cast("int") for d in own), F.lit(0)),
    }).withColumn(
        "needed_non_iso", F.coalesce(F.col("date_format") != ladder[0].label, F.lit(False)))
    return out.drop(*tried)


def parsed_date(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    return F.coalesce(*[read_rung(c, r) for r in ladder])


def date_format(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    """Label of the first format that reads the value, else null."""
    return _first_label([read_rung(c, r) for r in ladder], ladder)


def date_ambiguity(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    """The other reading of the text with day and month exchanged, when it is another date."""
    label, other = F.lit(None).cast("string"), F.lit(None).cast("date")
    for rung in reversed([r for r in ladder if r.swapped_iso]):
        own, alt = read_rung(c, rung), read_swapped(c, rung)
        differs = F.coalesce(own != alt, F.lit(False))
        label = F.when(differs, F.lit(rung.swapped_label)).otherwise(label)
        other = F.when(differs, alt).otherwise(other)
    return F.struct(label.alias("swapped_format"), other.alias("swapped_date"))


def parse_date_multiformat(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    """Struct of value, format, swapped_format and swapped_date. Never raises."""
    swapped = date_ambiguity(c, ladder)
    return F.struct(
        parsed_date(c, ladder).alias("value"), date_format(c, ladder).alias("format"),
        swapped["swapped_format"].alias("swapped_format"),
        swapped["swapped_date"].alias("swapped_date"))


def all_matching_formats(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    return F.array_compact(F.array(
        *[F.when(read_rung(c, r).isNotNull(), F.lit(r.label)) for r in ladder]))


def is_date(c: Column, ladder: Ladder = DATE_LADDER) -> Column:
    return parsed_date(c, ladder).isNotNull()


def to_iso_date(c: Column) -> Column:
    """Any date-like text as ISO text; blanks give null; anything else stops the job."""
    text = trimmed(c.cast("string"))
    empty = text.isNull() | F.lower(text).isin("", "nan", "nat", "none")
    day = read_rung(F.substring(text, 1, 10), DATE_LADDER[0])
    broken = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("string")
    return F.when(~empty, F.coalesce(F.date_format(day, "yyyy-MM-dd"), broken))


def calendar_parts(d: Column) -> dict[str, Column]:
    """Calendar columns of a date; Sunday is day 0."""
    dow = F.dayofweek(d) - 1
    return {
        "date_key": (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int"),
        "year": F.year(d),
        "quarter": F.quarter(d),
        "month": F.month(d),
        "year_month": F.date_format(d, "yyyy-MM"),
        "month_name": F.date_format(d, "MMMM"),
        "day_of_month": F.dayofmonth(d),
        "day_of_week": dow,
        "is_weekend": dow.isin(0, 6).cast("int"),
    }
