"""Column and table profiles of raw text tables.

Pass one folds every column to (column, value, count) with equal values combined before the
shuffle; every count, rate and histogram is a weighted aggregate of that table, so each
grammar is tested once per distinct value, not once per row. Pass two fetches the few
examples that depend on the inferred type.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillproof.config import RunConfig
from tillproof.functions import dates, money
from tillproof.functions.text import IDENTIFIER, is_blank_string, is_missing, normalise_text
from tillproof.scale import written

# Thresholds of the type rules.
CONFIDENCE = 0.95
MAX_CATEGORIES = 25
MAX_CATEGORY_RATIO = 0.5
MIN_KEY_RATIO = 0.5
TOP_VALUES = 5
SAMPLES = 5
LENGTHS = 10
FAILURE_EXAMPLES = 5
# Of so many parts of the rows, so many refute relationships first; more than half of them, so most rules fall.
PARTS, FIRST_PART = 16, 9
MIN_RELATION_RATE = 0.5
# A sketch has 2^SKETCH_BITS registers, from which its standard error follows.
SKETCH_BITS = 14
SKETCH_ERROR = 1.04 / (1 << SKETCH_BITS - 1) ** 0.5
KEY_LISTING = 25
MISMATCH_EXAMPLES = 10

NUMERIC_TYPES = ("integer", "decimal", "currency_string")


def _ratio(top: Column, bottom: Column) -> Column:
    """Six decimals, zero when there is nothing to divide by."""
    return money.ratio_or_zero(top, bottom)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) for every cell, plus source_row when the table has one."""
    keep = ["source_row"] if "source_row" in df.columns else []
    texts = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(keep, columns, "column_name", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_form(df.select(*columns), columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _weight(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _observed(counts: DataFrame) -> DataFrame:
    """Trimmed, non-missing tokens; values that differ in outer white space fold together."""
    return counts.withColumn("token", normalise_text(F.col("value"))).filter("token is not null")


def profile_missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cells, nulls and blanks per column: one aggregate over the table, nothing is shuffled but
    its partial counts."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counted = texts.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(is_missing(F.col(c))).alias(f"_m{i}") for i, c in enumerate(columns)],
        *[F.count_if(is_blank_string(F.col(c))).alias(f"_b{i}") for i, c in enumerate(columns)])
    each = counted.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col("_rows").alias("row_count"), F.col(f"_m{i}").alias("null_count"),
        F.col(f"_b{i}").alias("blank_count"), (F.col("_rows") - F.col(f"_m{i}")).alias("non_null_count"))
        for i, c in enumerate(columns)])))
    return each.withColumn("null_pct", _ratio(F.col("null_count"), F.col("row_count")))


def profile_distinct(counts: DataFrame) -> DataFrame:
    """Exact distinct counts of the raw values present."""
    present = ~is_missing(F.col("value"))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"), F.count_if(present).alias("distinct_count"),
        _weight(present).alias("_held"),
    ).select(
        "column_name", "distinct_count", _ratio(F.col("distinct_count"), F.col("row_count")).alias("distinct_pct"),
        ((F.col("distinct_count") == F.col("_held")) & (F.col("_held") == F.col("row_count")) & (F.col("_held") > 0)).alias("is_unique"),
        (F.col("distinct_count") == 1).alias("is_constant"))


def distinct_sketches(df: DataFrame, columns: list[str], part: Column) -> DataFrame:
    """C2, opt-in: part, column_name, cells, sketch: a HyperLogLog sketch of the values present in every
    part of a table (a file, a day). Sketches are small binaries that can be kept and merged later."""
    cells = df.select(part.cast("string").alias("part"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ["part"], columns, "column_name", "value").filter(~is_missing(F.col("value")))
    return cells.groupBy("part", "column_name").agg(
        F.count(F.lit(1)).alias("cells"), F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"))


def approximate_distinct(sketches: DataFrame, by: tuple[str, ...] = ("column_name",)) -> DataFrame:
    """Distinct values, about, of all parts together: sketches are merged, no value is read again. The
    standard error is SKETCH_ERROR."""
    merged = sketches.groupBy(*by).agg(F.sum("cells").alias("cells"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "cells", F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Surplus copies of whole rows; copies combine before the shuffle."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_pct", _ratio(F.col("duplicate_rows"), F.col("row_count")))


def length_histogram(counts: DataFrame, limit: int = LENGTHS) -> DataFrame:
    """The commonest trimmed lengths of each column, with the smallest and largest of all."""
    by_length = _observed(counts).groupBy("column_name", F.length("token").alias("chars")).agg(
        F.sum("n").alias("cells"))
    everything = W.partitionBy("column_name")
    rank = F.row_number().over(everything.orderBy(F.col("cells").desc(), F.col("chars").asc()))
    return (
        by_length.withColumns({
            "min_chars": F.min("chars").over(everything), "max_chars": F.max("chars").over(everything),
            "length_rank": rank})
        .filter(F.col("length_rank") <= limit))


def top_values(counts: DataFrame, limit: int = TOP_VALUES, most_values: int | None = None) -> DataFrame:
    """Commonest values, null among them, of columns with any; ties by value with null after
    every text. ``most_values`` leaves out columns with more distinct values than that."""
    held = F.col("distinct_count") >= 1
    distinct = profile_distinct(counts).filter(
        held if most_values is None else held & (F.col("distinct_count") <= most_values)).select("column_name")
    order = W.partitionBy("column_name").orderBy(
        F.col("n").desc(), F.col("value").asc_nulls_last())
    total = counts.groupBy("column_name").agg(F.sum("n").alias("_all"))
    return (
        counts.join(F.broadcast(distinct), "column_name")
        .withColumn("value_rank", F.row_number().over(order)).filter(F.col("value_rank") <= limit)
        .join(F.broadcast(total), "column_name")
        .select("column_name", "value_rank", "value", F.col("n").alias("cells"),
                _ratio(F.col("n"), F.col("_all")).alias("pct")))


def sample_values(df: DataFrame, columns: list[str], rows: int, k: int = SAMPLES) -> DataFrame:
    """Raw values at k evenly spaced places of a table whose source_row is dense from 0."""
    places = sorted({round(i * (rows - 1) / (k - 1)) for i in range(k)}) if rows > k else list(range(rows))
    return long_form(df.filter(F.col("source_row").isin(places)), columns)


def spaced_rows(df: DataFrame, k: int = SAMPLES) -> list[int]:
    """``source_row`` of k rows, evenly spaced from the first to the last; with gaps, the next row there is."""
    low, high = df.agg(F.min("source_row"), F.max("source_row")).first()
    if low is None:
        return []
    at = sorted({low + round(i * (high - low) / (k - 1)) for i in range(k)})
    return sorted(set(df.agg(*[F.min(F.when(F.col("source_row") >= t, F.col("source_row"))) for t in at]).first()))


def type_evidence(counts: DataFrame, config: RunConfig) -> DataFrame:
    """Share of observable cells that satisfy each grammar."""
    tests = {
        "int_rate": money.is_parseable_int(F.col("token")),
        "decimal_rate": money.is_parseable_decimal(F.col("token")),
        "currency_rate": money.to_decimal(F.col("token")).isNotNull(),
        "date_rate": dates.is_date(F.col("token"), config.ladder),
        "identifier_rate": F.col("token").rlike(IDENTIFIER),
    }
    tokens = _observed(counts).groupBy("column_name", "token").agg(F.sum("n").alias("n"))
    tested = tokens.withColumns({**tests, "marked": money.has_currency_marker(F.col("token"))})
    seen = tested.groupBy("column_name").agg(
        F.sum("n").alias("observable_count"), F.count(F.lit(1)).alias("distinct_tokens"),
        *[_weight(F.col(name)).alias(name) for name in tests], _weight(F.col("marked")).alias("marker_count"))
    rates = {name: _ratio(F.col(name), F.col("observable_count")) for name in tests}
    rated = seen.withColumns({**rates, "distinct_ratio": _ratio(F.col("distinct_tokens"), F.col("observable_count"))})
    empty = counts.select("column_name").distinct()
    filled = empty.join(F.broadcast(rated), "column_name", "left")
    return filled.select("column_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in rated.columns[1:]])


def infer_semantic_type(evidence: DataFrame) -> DataFrame:
    """The first rule that holds, with the share of cells that back it."""
    e = F.col
    named_like_key = F.lower("column_name").rlike("(_id|_key|id|code)$")
    like_key = (e("identifier_rate") >= CONFIDENCE) | (named_like_key & (e("identifier_rate") >= 0.5))
    # The counts decide, not their rounded ratio, so a type does not change with the row count.
    category = (e("distinct_tokens") <= MAX_CATEGORIES) & (e("distinct_tokens") <= MAX_CATEGORY_RATIO * e("observable_count"))
    many = e("distinct_tokens") >= MIN_KEY_RATIO * e("observable_count")
    rules = (
        (e("observable_count") == 0, "empty", F.lit(1.0)),
        (e("date_rate") >= CONFIDENCE, "date", e("date_rate")),
        ((e("marker_count") > 0) & (e("currency_rate") >= CONFIDENCE), "currency_string", e("currency_rate")),
        (e("int_rate") >= CONFIDENCE, "integer", e("int_rate")),
        (e("decimal_rate") >= CONFIDENCE, "decimal", e("decimal_rate")),
        (like_key & many, "identifier", e("identifier_rate")),
        (category, "categorical", F.lit(1.0)),
        (like_key, "identifier", e("identifier_rate")),
    )
    kind, trust = F.lit("free_text"), F.lit(1.0)
    for holds, name, rate in reversed(rules):
        kind = F.when(holds, F.lit(name)).otherwise(kind)
        trust = F.when(holds, rate).otherwise(trust)
    return evidence.select("*", kind.alias("semantic_type"), trust.cast("double").alias("confidence"))


def _fails(token: Column, config: RunConfig) -> Column:
    kind = F.col("semantic_type")
    return F.coalesce(
        F.when(kind == "integer", ~money.is_parseable_int(token))
        .when(kind == "decimal", ~money.is_parseable_decimal(token))
        .when(kind == "currency_string", money.to_decimal(token).isNull())
        .when(kind == "date", ~dates.is_date(token, config.ladder)), F.lit(False))


def parse_failures(counts: DataFrame, types: DataFrame, config: RunConfig) -> DataFrame:
    """Cells per column that do not satisfy the inferred type."""
    typed = _observed(counts).join(F.broadcast(types.select("column_name", "semantic_type")), "column_name")
    return typed.withColumn("_fails", _fails(F.col("token"), config)).groupBy("column_name", "semantic_type").agg(
        _weight(F.col("_fails")).alias("parse_failure_count"))


def parse_failure_examples(
    df: DataFrame, columns: list[str], types: DataFrame, config: RunConfig,
    limit: int = FAILURE_EXAMPLES,
) -> DataFrame:
    """First failing cells in source order; the rank filter runs before the shuffle."""
    cells = long_form(df, columns).join(F.broadcast(types.select("column_name", "semantic_type")), "column_name")
    failing = cells.withColumn("token", normalise_text(F.col("value"))).filter(
        F.col("token").isNotNull() & _fails(F.col("token"), config))
    rank = F.row_number().over(W.partitionBy("column_name").orderBy("source_row"))
    return failing.withColumn("example_rank", rank).filter(F.col("example_rank") <= limit).select(
        "column_name", "example_rank", "source_row", "token")


def numeric_stats(counts: DataFrame, types: DataFrame) -> DataFrame:
    """Range, mean and sum of numeric columns over exact decimals, zero and negative counts."""
    numeric = types.filter(F.col("semantic_type").isin(*NUMERIC_TYPES)).select("column_name")
    parsed = _observed(counts).join(F.broadcast(numeric), "column_name").withColumn(
        "x", money.to_decimal(F.col("token")))
    held = F.col("x").isNotNull()
    total = F.sum(F.col("x") * F.col("n"))
    count = _weight(held)
    six = lambda c: F.round(c * 1e6) / 1e6
    return parsed.groupBy("column_name").agg(
        F.min("x").cast("double").alias("min_value"), F.max("x").cast("double").alias("max_value"),
        total.cast("double").alias("sum_value"), count.alias("parsed_count"),
        six(F.try_divide(total.cast("double"), count)).alias("mean_value"),
        _weight(F.col("x") == 0).alias("zero_count"), _weight(F.col("x") < 0).alias("negative_count"),
        _weight(money.has_currency_marker(F.col("token"))).alias("marker_count"))


DATE_KINDS = ("unmatched", "ambiguous", "after_as_of")


def _odd_dates(values: DataFrame, config: RunConfig) -> DataFrame:
    """The rows whose ``value`` is one of the DATE_KINDS, with the token and the kinds."""
    read = dates.with_date_reading(values.withColumn("token", normalise_text(F.col("value"))), "token", config.ladder)
    day = F.col("parsed_date")
    holds = (F.col("token").isNotNull() & day.isNull(), F.col("date_format_count") > 1, day > F.lit(config.as_of))
    kinds = F.array_compact(F.array(*[F.when(c, F.lit(kind)) for kind, c in zip(DATE_KINDS, holds)]))
    return read.select(*values.columns, "token", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _first_odd_dates(cells: DataFrame, limit: int) -> DataFrame:
    """The first of every kind, in source order; the rank filter runs before the shuffle."""
    rank = F.row_number().over(W.partitionBy("column_name", "example_kind").orderBy("source_row", "token"))
    return cells.select("column_name", "source_row", "token", F.explode("kinds").alias("example_kind")).withColumn(
        "example_rank", rank).filter(F.col("example_rank") <= limit)


def date_format_report(
    counts: DataFrame, config: RunConfig, df: DataFrame | None = None, limit: int = FAILURE_EXAMPLES,
) -> DataFrame:
    """How the date cells of each column read under the ladder, with the first cells that match no format,
    several formats, or lie after the reference date.

    The examples come from ``df``, the rows that were counted, in source order. Without it the counted
    values stand for the cells, in the order of their text.
    """
    counts = written(counts, "date-values")  # what is read below, twice or more, without the other columns
    labels = [r.label for r in config.ladder]
    tokens = dates.with_date_reading(_observed(counts), "token", config.ladder).withColumnsRenamed(
        {"date_format": "fmt", "parsed_date": "day"})
    report = tokens.groupBy("column_name").agg(
        F.sum("n").alias("observable_count"),
        *[_weight(F.col("fmt") == name).alias(f"_f{i}") for i, name in enumerate(labels)],
        _weight(F.col("fmt").isNull()).alias("unmatched_count"),
        _weight(F.col("date_format_count") > 1).alias("ambiguous_count"),
        F.min("day").alias("min_date"), F.max("day").alias("max_date"),
        _weight(F.col("day") > F.lit(config.as_of)).alias("after_as_of_count"))
    hits = [F.col(f"_f{i}") for i in range(len(labels))]
    best = F.greatest(*hits)
    dominant = F.coalesce(*[F.when((h == best) & (h > 0), F.lit(n)) for h, n in zip(hits, labels)])
    # Names first, so that no other column of the rows is read. Values are tested once each; cells look them up.
    names = [] if df is None else sorted(r.column_name for r in counts.select("column_name").distinct().collect())
    odd = _odd_dates(counts.select("column_name", "value"), config)
    cells = long_form(df, names).join(written(odd, "odd-dates"), ["column_name", "value"]) if names else odd.withColumn(
        "source_row", F.lit(None).cast("long"))
    of_kind = lambda kind: F.collect_list(F.when(F.col("example_kind") == kind, F.struct("example_rank", "token")))
    examples = _first_odd_dates(cells, limit).groupBy("column_name").agg(*[
        F.transform(F.array_sort(of_kind(kind)), lambda e: e["token"]).alias(f"{kind}_examples") for kind in DATE_KINDS])
    report = report.join(F.broadcast(examples), "column_name", "left")  # a row per column
    shown = {kind: F.coalesce(f"{kind}_examples", F.array().cast("array<string>")).alias(f"{kind}_examples") for kind in DATE_KINDS}
    return report.select(
        "column_name", "observable_count",
        F.to_json(F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*hits))).alias("format_histogram"),
        sum(((h > 0).cast("int") for h in hits), F.lit(0)).alias("distinct_format_count"),
        dominant.alias("dominant_format"),
        _ratio(best, F.col("observable_count")).alias("dominant_coverage"),
        (F.col("observable_count") - best).alias("rows_lost_to_single_format"),
        "unmatched_count", shown["unmatched"], "ambiguous_count", shown["ambiguous"], "min_date", "max_date",
        "after_as_of_count", shown["after_as_of"])


def date_examples(
    df: DataFrame, column: str, config: RunConfig, limit: int = FAILURE_EXAMPLES,
) -> DataFrame:
    """First cells that match no format, several formats, or lie after the reference date."""
    return _first_odd_dates(_odd_dates(long_form(df, [column]), config), limit).drop("column_name")


def candidate_keys(profile: DataFrame) -> DataFrame:
    """Columns worth testing as a key: typed identifier or observed unique."""
    return profile.filter((F.col("semantic_type") == "identifier") | F.col("is_unique")).withColumn(
        "key_rank", F.row_number().over(W.orderBy(F.col("distinct_pct").desc(), F.col("position").asc()))
    ).select("key_rank", "column_name", "semantic_type", "distinct_pct", "is_unique")


def _key_groups(df: DataFrame, key: str) -> DataFrame:
    """Per key: rows, distinct rows and, per other column, whether its values differ.

    Equal rows are combined first. Minimum, maximum and the presence of null decide whether
    a column differs, so no set of values is ever gathered.
    """
    others = [c for c in df.columns if c not in (key, "source_row")]
    whole = df.filter(~is_missing(F.col(key).cast("string"))).groupBy(key, *others).agg(
        F.count(F.lit(1)).alias("_n"))
    every = F.count(F.lit(1))
    differs = [
        (((F.count(c) > 0) & (F.count(c) < every)) | F.coalesce(F.min(c) != F.max(c), F.lit(False))).alias(f"_d_{c}")
        for c in others]
    grouped = whole.groupBy(key).agg(F.sum("_n").alias("row_count"), every.alias("distinct_row_count"), *differs)
    return grouped.select(
        key, "row_count", "distinct_row_count",
        F.array_compact(F.array(*[F.when(F.col(f"_d_{c}"), F.lit(c)) for c in others])).alias("differing_columns"))


def pk_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row on the column as a key; exact copies are told from real conflicts."""
    groups = _key_groups(df, key)
    nulls = df.agg(F.count_if(is_missing(F.col(key).cast("string")))).scalar()
    twice = F.col("row_count") > 1
    exact = twice & (F.col("distinct_row_count") == 1)
    return groups.agg(
        F.count(F.lit(1)).alias("distinct_key_count"), F.count_if(twice).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.when(twice, F.col("row_count"))), F.lit(0)).alias("duplicated_row_count"),
        F.count_if(exact).alias("exact_duplicate_key_count"),
        F.coalesce(F.sum(F.when(exact, F.col("row_count") - 1)), F.lit(0)).alias("exact_duplicate_row_count"),
        F.count_if(twice & ~exact).alias("conflicting_key_count"),
    ).withColumn("null_key_count", nulls).withColumn(
        "is_unique", (F.col("duplicate_key_count") == 0) & (F.col("null_key_count") == 0))


def pk_conflicts(df: DataFrame, key: str) -> DataFrame:
    """Every key whose rows differ, with the columns that do."""
    return _key_groups(df, key).filter("distinct_row_count > 1").select(
        F.col(key).cast("string").alias("key_value"), "row_count", "distinct_row_count",
        F.concat_ws(",", "differing_columns").alias("differing_columns"))


def pk_conflict_values(df: DataFrame, key: str) -> DataFrame:
    """(key_value, column_name, value) for every differing column, null included, one value
    per row so a key with many versions is many rows and never one large cell."""
    others = [c for c in df.columns if c not in (key, "source_row")]
    pairs = df.filter(~is_missing(F.col(key).cast("string"))).select(
        F.col(key).cast("string").alias("key_value"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in others]))
    ).distinct()
    # A column differs when it has a second value; two extremes and a null test show that.
    both = pairs.groupBy("key_value", "column_name").agg(
        F.min("value").alias("_a"), F.max("value").alias("_b"),
        F.count_if(F.col("value").isNull()).alias("_nulls")).filter(
        (F.col("_a") != F.col("_b")) | ((F.col("_nulls") > 0) & F.col("_a").isNotNull()))
    return pairs.join(both.select("key_value", "column_name"), ["key_value", "column_name"], "left_semi")


def referential_integrity(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: orphans and unreferenced parents, with the first keys of each and whether there
    are more."""
    missing = is_missing(F.col(key).cast("string"))
    # One row per key, written: the rows of the child are read once.
    used = written(child.groupBy(F.when(~missing, F.col(key).cast("string")).alias("k")).agg(F.count(F.lit(1)).alias("n")), "used-keys")
    known = parent.filter(~is_missing(F.col(parent_key).cast("string"))).select(
        F.col(parent_key).cast("string").alias("k"), F.lit(True).alias("known")).distinct()
    # Both sides hold one row per key, so a hot key weighs no more than any other.
    both = written(used.filter("k is not null").join(known, "k", "full"), "key-pairs")
    orphan = F.col("known").isNull()
    idle = F.col("n").isNull()
    counts = both.agg(
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("orphan_row_count"),
        F.count_if(orphan).alias("orphan_key_count"), F.count_if(idle).alias("unreferenced_parent_count"),
        F.count("known").alias("parent_key_count"))
    rows = used.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    nulls = used.agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0))).scalar()

    def listed(which: Column, name: str) -> DataFrame:
        first = both.filter(which).select("k").orderBy("k").limit(KEY_LISTING)
        return first.agg(F.concat_ws(",", F.sort_array(F.collect_list("k"))).alias(name))

    return counts.withColumns({
        "child_row_count": rows, "null_key_count": nulls,
        "orphan_rate": _ratio(F.col("orphan_row_count"), rows),
        "orphan_keys": listed(orphan, "v").scalar(), "unreferenced_parent_keys": listed(idle, "v").scalar(),
        "orphan_keys_truncated": F.col("orphan_key_count") > KEY_LISTING,
        "unreferenced_parent_keys_truncated": F.col("unreferenced_parent_count") > KEY_LISTING,
    })


def _line(left: str, factors: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Reported value, product and signed delta of one candidate rule."""
    reported = money.to_decimal(F.col(left)).cast("double")
    product = reduce(lambda a, b: a * b, [money.to_decimal(F.col(f)).cast("double") for f in factors])
    return reported, product, product - reported


def arithmetic_reconciliation(
    df: DataFrame, left: str, factors: tuple[str, ...], tolerance: float = 0.01,
) -> DataFrame:
    """One row on the rule left = product of factors; a positive delta means less was
    reported than the factors give."""
    reported, product, delta = _line(left, factors)
    rows = df.select(reported.alias("reported"), product.alias("product"), delta.alias("delta"))
    usable = F.col("delta").isNotNull()
    miss = usable & (F.abs("delta") > tolerance)
    four = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)) * 1e4) / 1e4
    relative = F.abs(F.try_divide("delta", F.when(F.col("product") != 0, F.col("product"))))
    return rows.agg(
        F.count_if(usable).alias("comparable_row_count"), F.count_if(~usable).alias("unparseable_row_count"),
        F.count_if(usable & ~miss).alias("match_count"), F.count_if(miss).alias("mismatch_count"),
        # Deltas are added exactly and rounded once, after the sum.
        four(F.sum(F.when(miss, F.col("delta").cast("decimal(28,9)")))).alias("total_signed_delta"),
        four(F.sum(F.when(miss, F.abs(F.col("delta")).cast("decimal(28,9)")))).alias("total_absolute_delta"),
        four(F.max(F.when(usable, F.abs("delta")))).alias("max_absolute_delta"),
        (F.round(F.avg(F.when(miss, relative)) * 1e6) / 1e6).alias("mean_relative_delta"),
    ).withColumn("match_rate", F.round(F.try_divide(
        F.col("match_count") * 1e6, F.col("comparable_row_count"))) / 1e6)


def reconciliation_examples(
    df: DataFrame, left: str, factors: tuple[str, ...], tolerance: float = 0.01,
    limit: int = MISMATCH_EXAMPLES,
) -> DataFrame:
    reported, product, delta = _line(left, factors)
    return df.select("source_row", reported.alias("reported"), product.alias("computed"), delta.alias("delta"),
                     *[normalise_text(F.col(f)).alias(f"factor_{f}") for f in factors]).filter(
        F.abs("delta") > tolerance).orderBy("source_row").limit(limit)


def _numbers(df: DataFrame, columns: list[str]) -> Column:
    """The columns as an array of doubles. Plain decimals take a short path, and text is read by one
    expression for all columns."""
    plain = lambda c: F.when(c.rlike(r"^[+-]?\d{1,18}(\.\d{1,6})?$"), c.try_cast("double")).otherwise(money.to_decimal(c).cast("double"))
    return F.transform(F.array(*[F.col(c).cast("string") for c in columns]), plain)


def _rule_counts(rows: DataFrame, pairs: list[tuple[int, int]], targets: int, count: str, holds: Callable[[int], str]) -> DataFrame:
    """pair, target, n: ``count`` summed where ``holds(target)`` for the pair ``p``, for rows where any target holds.

    A row is spread to its pairs, and dropped again where no target holds, before anything is added up.
    Expressions are given as text, as there are some for every pair.
    """
    listed = ", ".join(f"named_struct('i', {i}, 'a', {a}, 'b', {b}, 'bits', {1 << a | 1 << b}L)" for i, (a, b) in enumerate(pairs))
    spread = rows.withColumn("p", F.expr(f"explode(array({listed}))"))
    found = spread.filter(" OR ".join(f"coalesce({holds(t)}, false)" for t in range(targets))).groupBy(F.col("p.i").alias("pair"))
    sums = F.expr(f"array({', '.join(f'sum(CASE WHEN {holds(t)} THEN {count} END)' for t in range(targets))})")
    return found.agg(sums.alias("sums")).select("pair", F.posexplode("sums").alias("target", "n")).filter("n > 0")


def discover_relationships(df: DataFrame, columns: list[str], tolerance: float = 0.01) -> DataFrame:
    """Every target and unordered factor pair among three or more numeric columns; rules that
    hold for half the rows or more are kept.

    Rules are refuted first: FIRST_PART of the rows are tested under all rules. A rule that would not
    reach half even if every other row kept it is retired; most are, as that part is more than half.
    What is left is tested on the other rows, so its counts are those of all rows. How many rows a rule
    applies to is counted from the patterns of present values alone. The driver sees rules, never rows.
    """
    spark, every, n = df.sparkSession, sorted(columns), len(columns)
    none = "relationship string, target string, comparable_row_count long, match_count long, match_rate double"
    if n < 3:
        return spark.createDataFrame([], none)
    pairs = list(combinations(range(n), 2))
    rows = written(df.select(_numbers(df, every).alias("v"), (F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)) < FIRST_PART).alias("_part")), "parsed")
    bits = F.aggregate(F.transform("v", lambda x, i: F.when(x.isNotNull(), F.pow(F.lit(2.0), i).cast("long")).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    patterns = written(rows.groupBy(bits.alias("bits"), "_part").agg(F.count(F.lit(1)).alias("n")), "patterns")
    present = lambda t: f"bits & (p.bits | {1 << t}L) = (p.bits | {1 << t}L)"
    kept = lambda t: f"abs(get(v, p.a) * get(v, p.b) - get(v, {t})) <= {tolerance}"
    names = ["pair", "target"]

    comparable = written(_rule_counts(patterns, pairs, n, "n", present).withColumnRenamed("n", "comparable"), "comparable")
    first = written(_rule_counts(rows.filter("_part"), pairs, n, "1", kept).withColumnRenamed("n", "matching"), "first-part")
    rest = _rule_counts(patterns.filter("NOT _part"), pairs, n, "n", present).withColumnRenamed("n", "open")
    # As the rate is rounded when rules are kept, a rule this close is not retired.
    alive = comparable.join(first, names, "left").join(rest, names, "left").fillna(0).filter(
        F.col("matching") + F.col("open") >= F.col("comparable") * (MIN_RELATION_RATE - 1e-6))
    survivors = [tuple(r) for r in alive.select(*names).collect() if r.target not in pairs[r.pair]]
    left = sorted({p for p, _ in survivors})
    if not survivors:
        return spark.createDataFrame([], none)
    renumbered = spark.createDataFrame(
        [(new, t, old, every[t], f"{every[t]} ~= {every[pairs[old][0]]} * {every[pairs[old][1]]}") for new, old in enumerate(left) for p, t in survivors if p == old],
        "place int, target int, pair int, name string, relationship string")
    second = _rule_counts(rows.filter("NOT _part"), [pairs[p] for p in left], n, "1", kept).select(F.col("pair").alias("place"), "target", F.col("n").alias("more"))
    # One row per rule from here on.
    tested = renumbered.join(second, ["place", "target"], "left").join(comparable, names).join(first, names, "left").fillna(0)
    count = F.col("matching") + F.col("more")
    rate = F.round(F.try_divide(count * 1e6, F.col("comparable"))) / 1e6
    return tested.select(
        "relationship", F.col("name").alias("target"), F.col("comparable").alias("comparable_row_count"), count.alias("match_count"), rate.alias("match_rate"),
    ).filter(F.col("match_rate") >= MIN_RELATION_RATE).orderBy(F.col("match_rate").desc(), "target", "relationship")


def column_profile(
    df: DataFrame, columns: list[str], config: RunConfig, counts: DataFrame | None = None, evidence: DataFrame | None = None,
) -> DataFrame:
    """C17: one row per column with counts, type, confidence, failures and numeric range."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
    # Every part below starts from the counted values, so they are folded once and written.
    counts = counts or written(value_counts(df, columns), "value-counts")
    # One row per column, used by three parts.
    types = evidence or written(infer_semantic_type(type_evidence(counts, config)), "column-types")
    where = df.sparkSession.createDataFrame(list(enumerate(columns)), "position int, column_name string")
    # One row per column from here on; every side of these joins is that small.
    out = where.join(F.broadcast(profile_missingness(df, columns)), "column_name", "left")
    for part in (
        profile_distinct(counts), types.select("column_name", "semantic_type", "confidence"),
        parse_failures(counts, types, config).drop("semantic_type"),
        numeric_stats(counts, types).drop("parsed_count"),
    ):
        out = out.join(F.broadcast(part), "column_name", "left")
    zeros = ["row_count", "null_count", "blank_count", "non_null_count", "distinct_count", "parse_failure_count"]
    return out.fillna(0, subset=zeros).fillna({
        "null_pct": 0.0, "distinct_pct": 0.0, "is_unique": False, "is_constant": False,
        "semantic_type": "empty", "confidence": 1.0})


def profile_report(df: DataFrame, name: str, config: RunConfig, parents: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """C17: the whole report of one dataset: ``columns`` (one row per column, sections as structs and
    arrays), ``dataset`` (rows, duplicates), ``keys``, ``relationships`` and ``references``.

    The cells are folded to (column, value, count) once and written; every section of a column is an
    aggregate of that table. Only examples go back to the rows. ``parents`` maps a column to (table, key)
    it should refer to. ``df`` has ``source_row``.
    """
    columns = [c for c in df.columns if c != "source_row"]
    counts = written(value_counts(df, columns), "value-counts")
    evidence = written(infer_semantic_type(type_evidence(counts, config)), "column-types")
    flat = column_profile(df, columns, config, counts, evidence)
    listed = lambda rows, order, *fields: rows.groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_l"))  # a few rows per column
    lengths = length_histogram(counts)
    parts = {
        "lengths": lengths.groupBy("column_name").agg(
            F.min("min_chars").alias("min_length"), F.max("max_chars").alias("max_length"),
            F.array_sort(F.collect_list(F.struct("length_rank", "chars", "cells"))).alias("histogram")),
        "top_values": listed(top_values(counts), "value_rank", "value", "cells", "pct"),
        "samples": listed(long_form(df.filter(F.col("source_row").isin(spaced_rows(df))), columns), "source_row", "value"),
        "failures": listed(parse_failure_examples(df, columns, evidence, config), "example_rank", "source_row", "token"),
        "dates": date_format_report(counts.join(F.broadcast(evidence.filter("semantic_type = 'date'").select("column_name")), "column_name"), config, df),
        "evidence": evidence.drop("semantic_type", "confidence"),
    }
    for label, part in parts.items():
        own = [c for c in part.columns if c != "column_name"]
        nested = part.select("column_name", (F.col("_l") if own == ["_l"] else F.struct(*own)).alias(label))
        flat = flat.join(F.broadcast(nested), "column_name", "left")  # a row per column
    flat = flat.withColumn("dataset", F.lit(name))
    kinds = {r.column_name: (r.semantic_type, r.is_unique) for r in flat.select("column_name", "semantic_type", "is_unique").collect()}
    numeric = [c for c in columns if kinds[c][0] in NUMERIC_TYPES]
    keyed = [pk_uniqueness(df, c).withColumn("column_name", F.lit(c)) for c in columns if kinds[c][0] == "identifier" or kinds[c][1]]
    references = [referential_integrity(df, c, *parent).withColumn("column_name", F.lit(c)) for c, parent in (parents or {}).items()]
    report = {
        "columns": flat,
        "dataset": duplicate_rows(df, columns).withColumn("column_count", F.lit(len(columns))),
        "relationships": discover_relationships(df, numeric),
    }
    if keyed:
        report["keys"] = reduce(DataFrame.unionByName, keyed)
    if references:
        report["references"] = reduce(DataFrame.unionByName, references)
    return {section: part.withColumn("dataset", F.lit(name)) for section, part in report.items()}


def side_by_side(spark, items: list, work: Callable) -> list:
    """``work`` of every item, at the same time: each waits for writes of its own."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def profile_datasets(tables: dict[str, DataFrame], config: RunConfig) -> DataFrame:
    """The column profile of many tables, one under the other."""
    def one(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        return column_profile(df, [c for c in df.columns if c != "source_row"], config).withColumn("dataset", F.lit(name))

    return reduce(DataFrame.unionByName, side_by_side(next(iter(tables.values())).sparkSession, list(tables.items()), one))
