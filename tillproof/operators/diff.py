"""Cell-by-cell comparison of raw and clean values, with the reason for every change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillproof.config import RunConfig
from tillproof.functions import dates, money
from tillproof.functions.codes import mixed_sort_key, order_by_mixed
from tillproof.functions.text import is_missing, normalise_text
from tillproof.operators.transactions import COLUMNS
from tillproof.scale import lookup, written

# The column that explains an excluded row.
BLAMED = {"TX-01": "transaction_date", "TX-02": "total_amount", "TX-04": "store_id",
          "TX-05": "product_id", "TX-07": "quantity", "TX-08": "transaction_date",
          "TX-09": "transaction_id"}


def _cell(name: str, clean: Column, found: list[tuple[Column, str, str]]) -> Column:
    """Struct of one cell. ``found`` lists (condition, status, code) for kept rows."""
    kept = F.col("disposition") == "kept"
    blame = F.coalesce(*[
        F.when(F.col("reason_code") == code, F.lit(code)) for code, column in BLAMED.items() if column == name
    ], F.lit(None).cast("string")) if name in BLAMED.values() else F.lit(None).cast("string")
    status, code = F.lit("clean"), F.lit(None).cast("string")
    for condition, word, label in reversed(found):
        status = F.when(condition, F.lit(word)).otherwise(status)
        code = F.when(condition, F.lit(label).cast("string")).otherwise(code)
    return F.struct(
        F.lit(name).alias("column_name"), F.col(name).alias("raw_value"),
        F.when(kept, clean).otherwise(F.concat(F.lit("("), F.col("disposition"), F.lit(")"))).alias("clean_value"),
        F.when(kept, status).when(blame.isNotNull(), "error").otherwise("clean").alias("status"),
        F.when(kept, code).otherwise(blame).alias("defect_code"))


def raw_vs_clean_diff(flagged: DataFrame) -> DataFrame:
    """One record per source row and column. The working table holds both sides, so this is
    one projection without a join; dispositions are the ledger's own."""
    text = lambda c: normalise_text(F.col(c))
    as_text = lambda c: F.col(c).cast("string")
    cells = {
        "transaction_id": (text("transaction_id"), []),
        "transaction_date": (F.date_format("parsed_date", "yyyy-MM-dd"), [
            (F.col("needed_non_iso"), "fixed", "TX-01")]),
        "store_id": (text("store_id"), []),
        "product_id": (text("product_id"), []),
        "customer_id": (F.col("customer"), [(F.col("is_guest"), "fixed", "TX-06")]),
        "quantity": (as_text("parsed_quantity"), [(F.col("is_return"), "preserved", "TX-10")]),
        "unit_price": (as_text("parsed_unit_price"), []),
        "total_amount": (as_text("parsed_total_amount"), [
            (F.col("has_discount"), "preserved", "TX-03"),
            (F.col("currency_formatted"), "fixed", "TX-02")]),
    }
    rows = F.explode(F.array(*[_cell(c, *cells[c]) for c in COLUMNS]))
    return flagged.select("source_row", "transaction_id", "disposition", rows.alias("_cell")).select(
        "source_row", "transaction_id", "disposition", "_cell.*")


UNEXPLAINED = "unexplained"
CLEAN_COLUMNS = ("transaction_date", "store_id", "product_id", "customer_id", "quantity", "unit_price", "total_amount")


def published_row_diff(raw: DataFrame, published: DataFrame, lineage: DataFrame, config: RunConfig) -> DataFrame:
    """One record per source row, its cells as an array: raw text against what was published.

    The three tables meet on ``source_row``; bucketed by it, they do so without a shuffle. Nothing of the
    working table is used: what a rule should have made of the raw text is read anew from the text, and a
    published cell that differs from that, nulls included, is ``unexplained``. A row that is published
    counts as kept; one that the ledger keeps but is not published is ``missing``.
    """
    out = published.select("source_row", F.lit(True).alias("_there"), *[F.col(c).alias(f"_p_{c}") for c in ("transaction_id", *CLEAN_COLUMNS, "has_discount", "is_return")])
    ledger = lineage.select("source_row", F.col("disposition").alias("_said"), "reason_code", F.col("transaction_id").alias("_id"))
    source = raw.select("source_row", *COLUMNS)
    # A full join forgets how its rows lie, so the rows of the source, those that only the ledger knows and
    # those that only the publication knows come from a join each and stay in the buckets of their table.
    without = lambda side, *others: reduce(lambda a, b: a.join(b.select("source_row"), "source_row", "left_anti"), others, side)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        source.join(ledger, "source_row", "left").join(out, "source_row", "left"),
        without(ledger, source).join(out, "source_row", "left"), without(out, source, ledger)])
    rows = rows.withColumn("disposition", F.when(F.col("_there"), "kept").when(F.col("_said") == "kept", "missing").otherwise(F.col("_said")))
    rows = rows.withColumn("_id", F.coalesce("transaction_id", "_id", "_p_transaction_id"))
    # What is read from a cell's text is a column first, read once and then picked. Spark fuses no projection
    # that has a function of array elements into one method with its neighbours, which here would be too long
    # for the JVM to compile; so the texts and the cells go through one.
    names = [c for c in COLUMNS if c not in ("transaction_date", "quantity", "unit_price", "total_amount")]
    read = dates.with_date_reading(rows, "transaction_date", config.ladder).withColumns({
        "_texts": F.transform(F.array(*names), normalise_text), "_guest": is_missing(F.col("customer_id")),
        "_quantity": money.coerce_int(F.col("quantity")), "_unit_price": money.parse_currency(F.col("unit_price")),
        "_total_amount": money.parse_currency(F.col("total_amount")), "_marked": money.is_currency_formatted(F.col("total_amount"))})
    expected = {name: F.get("_texts", F.lit(k)) for k, name in enumerate(names)} | {
        "transaction_date": F.col("parsed_date"), **{c: F.col(f"_{c}") for c in ("quantity", "unit_price", "total_amount")}}
    expected["customer_id"] = F.when(F.col("_guest"), F.lit(config.guest_id)).otherwise(expected["customer_id"])
    read = read.withColumns({f"_off_{name}": ~expected[name].eqNullSafe(F.col(f"_p_{name}")) for name in COLUMNS})
    rules = {
        "transaction_date": [(F.col("needed_non_iso"), "fixed", "TX-01")], "customer_id": [(F.col("_guest"), "fixed", "TX-06")],
        "quantity": [(F.col("_p_is_return"), "preserved", "TX-10")],
        "total_amount": [(F.col("_p_has_discount"), "preserved", "TX-03"), (F.col("_marked"), "fixed", "TX-02")]}
    cells = []
    for name in COLUMNS:
        shown = F.col(f"_p_{name}")
        off = [(F.col(f"_off_{name}"), UNEXPLAINED, None)]
        cells.append(_cell(name, F.date_format(shown, "yyyy-MM-dd") if name == "transaction_date" else shown.cast("string"), off + rules.get(name, [])))
    return read.select("source_row", F.col("_id").alias("transaction_id"), "disposition", F.array(*cells).alias("cells"))


def published_diff(raw: DataFrame, published: DataFrame, lineage: DataFrame, config: RunConfig) -> DataFrame:
    """One record per source row and column: the cells of ``published_row_diff``.

    A row always has cells. Said to the optimizer by the outer form, which does not build them twice to test that."""
    return published_row_diff(raw, published, lineage, config).select(
        "source_row", "transaction_id", "disposition", F.inline_outer("cells"))


def explain(diff: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach the catalogue's words to every coded cell."""
    words = catalog.select(
        F.col("code").alias("defect_code"), F.concat_ws(". ", "title", "decision").alias("explanation"))
    return diff.join(F.broadcast(words), "defect_code", "left")


def dimension_diff(
    rows: DataFrame, clean: DataFrame, lost: DataFrame, key: str, columns: dict[str, str],
    rules: dict[str, tuple[str, str]],
) -> DataFrame:
    """The same for a dimension. ``lost`` gives (source_row, code) of rows that were not
    elected; ``columns`` maps raw to clean names; ``rules`` maps a raw column to
    (clean flag column, code)."""
    side = clean.select(
        F.col(key).alias("_key"), *[F.col(c).cast("string").alias(f"_clean_{r}") for r, c in columns.items()],
        *[F.col(flag).cast("boolean").alias(f"_flag_{r}") for r, (flag, _) in rules.items()])
    marked = rows.join(lost.select("source_row", F.col("code").alias("_lost")), "source_row", "left")
    joined = lookup(marked.withColumn("_key", F.col(key)), side, ["_key"], "left")
    kept = F.col("_lost").isNull()
    cells = []
    for raw in columns:
        hit = F.coalesce(F.col(f"_flag_{raw}"), F.lit(False)) if raw in rules else F.lit(False)
        code = F.when(hit, F.lit(rules[raw][1])) if raw in rules else F.lit(None).cast("string")
        blame = F.col("_lost") if raw == key else F.lit(None).cast("string")
        cells.append(F.struct(
            F.lit(raw).alias("column_name"), F.col(raw).alias("raw_value"),
            F.when(kept, F.col(f"_clean_{raw}")).otherwise("(dropped)").alias("clean_value"),
            F.when(kept & hit, "fixed").when(~kept & F.lit(raw == key), "error").otherwise("clean").alias("status"),
            F.when(kept, code).otherwise(blame).alias("defect_code")))
    return joined.select(
        "source_row", F.col(key).alias("row_key"),
        F.when(kept, "kept").otherwise("dropped").alias("disposition"),
        F.explode(F.array(*cells)).alias("_cell")).select(
        "source_row", "row_key", "disposition", "_cell.*")


def verify_diff(diff: DataFrame, lineage: DataFrame) -> DataFrame:
    """Row-for-row agreement of a diff with the ledger, as one row of counts. The diff has a record per
    cell, or one per row with ``cells``, of which only id and counts are gathered by row."""
    if "cells" in diff.columns:
        counted = diff.select("source_row", "disposition", "transaction_id", F.size("cells").alias("_n"),
                              F.size(F.filter("cells", lambda c: c["status"] == UNEXPLAINED)).alias("_u"))
    else:
        counted = diff.select("source_row", "disposition", "transaction_id", F.lit(1).alias("_n"),
                              F.when(F.col("status") == UNEXPLAINED, 1).otherwise(0).alias("_u"))
    rows = counted.groupBy("source_row").agg(
        F.min("disposition").alias("_a"), F.max("disposition").alias("_b"),
        F.min("transaction_id").alias("_id"), F.sum("_n").alias("_cells"), F.sum("_u").alias("_off"))
    both = rows.join(lineage, "source_row", "full")
    return both.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        F.count_if(F.col("_cells").isNull() | F.col("disposition").isNull()).alias("unmatched_rows"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("disposition"))
                   | ~F.col("_b").eqNullSafe(F.col("disposition"))).alias("disposition_mismatches"),
        F.count_if(~F.col("_id").eqNullSafe(F.col("transaction_id"))).alias("id_mismatches"),
        F.sum("_cells").alias("cells"), F.coalesce(F.sum("_off"), F.lit(0)).alias("unexplained_cells"))


def diff_browse(
    diff: DataFrame, code: str | None, column: str, side: str = "raw", ascending: bool = True,
) -> DataFrame:
    """Rows of the diff that carry ``code`` anywhere, in the order of one raw or clean column.

    The cells of a row are those of its array, where the diff has one record per row; otherwise they
    are gathered over the unique source_row.
    """
    value = f"{side}_value"
    if "cells" in diff.columns:
        found = F.struct(
            F.array_sort(F.array_compact(F.array_distinct(F.col("cells.defect_code")))).alias("defects"),
            F.array_max(F.transform(F.filter("cells", lambda c: c["column_name"] == column), lambda c: c[value])).alias("sort_value"))
        # A filter stays above a generator, so the cells are not built once for it and once more for the row.
        rows = diff.select("source_row", "transaction_id", "disposition", F.explode_outer(F.array(found)).alias("_row")).select(
            "source_row", "transaction_id", "disposition", "_row.*")
    else:
        rows = diff.groupBy("source_row", "transaction_id", "disposition").agg(
            F.sort_array(F.collect_set("defect_code")).alias("defects"),
            F.max(F.when(F.col("column_name") == column, F.col(value))).alias("sort_value"))
    if code is not None:
        rows = rows.filter(F.array_contains("defects", code))
        # A sort reads its input twice, to sample it and to move it; the rows found are few and written first.
        rows = written(rows, "browsed") if "cells" in diff.columns else rows
    key = mixed_sort_key(F.col("sort_value"))
    return rows.withColumn("_key", key).select(
        "source_row", "transaction_id", "disposition", F.concat_ws(",", "defects").alias("defects"),
        "sort_value", "_key.*").orderBy(*order_by_mixed(F.col("sort_value"), ascending), F.col("source_row"))
