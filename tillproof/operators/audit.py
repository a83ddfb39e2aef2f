"""The defect ledger and the proof that every catalogued class was looked for and counted.

Detections are rows (code, dataset, source_row, row_key, disposition, counted); everything
here is an aggregate of them, joined to the seventeen-row catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tillproof.catalog import ACTIONS, DEFECT_CODES, SEVERITY_RANK
from tillproof.operators.transactions import DETECTION

# What is done about each class.
ACTION_OF: dict[str, str] = {
    "ST-01": "flagged", "ST-02": "dropped", "ST-03": "imputed", "PR-01": "dropped",
    "PR-02": "flagged", "PR-03": "imputed", "PR-04": "imputed",
    **{code: action for code, _, action in DETECTION},
}


def first_keys(detections: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` keys of each code in source order; the rank filter runs before the
    shuffle, so at most ``cap`` rows per code and task move."""
    rank = F.row_number().over(W.partitionBy("code").orderBy("source_row"))
    return (
        detections.filter("counted").select("code", "source_row", "row_key")
        .withColumn("_rank", rank).filter(F.col("_rank") <= cap)
        .groupBy("code").agg(
            F.sort_array(F.collect_list(F.struct("_rank", "row_key"))).alias("_keys"))
        .select("code", F.transform("_keys", lambda k: k["row_key"]).alias("affected_keys"))
    )


def defect_keys(detections: DataFrame) -> DataFrame:
    """Every counted key of every code, one per row: what the capped list of a record is cut from."""
    return detections.filter("counted").select("code", "source_row", "row_key")


def defect_ledger(
    detections: DataFrame, cap: int = 50, recorded: tuple[str, ...] = DEFECT_CODES,
) -> DataFrame:
    """One record per code a stage looked for, including those found nowhere."""
    spark = detections.sparkSession
    looked = spark.createDataFrame([(c, ACTION_OF[c]) for c in recorded], "code string, action string")
    counts = detections.groupBy("code").agg(F.count_if("counted").alias("detected_count"))
    found = F.coalesce("detected_count", F.lit(0))
    # What became of the rows, those that only bear witness included; a few outcomes per code.
    outcomes = detections.groupBy("code", "disposition").agg(F.count(F.lit(1)).alias("n")).groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("disposition", "n"))).alias("_o"))
    notes = F.array_join(F.transform("_o", lambda o: F.concat_ws(" ", o["n"].cast("string"), o["disposition"])), ", ")
    return (
        looked.join(F.broadcast(outcomes), "code", "left").join(F.broadcast(counts), "code", "left")
        .join(F.broadcast(first_keys(detections, cap)), "code", "left")
        .select(
            "code", found.alias("detected_count"), "action",
            F.coalesce("affected_keys", F.array().cast("array<string>")).alias("affected_keys"),
            found.alias("affected_keys_total"),
            (found > cap).alias("affected_keys_truncated"), F.coalesce(notes, F.lit("")).alias("notes"))
    )


def merge_records(records: DataFrame, cap: int = 50) -> DataFrame:
    """Repeated records of a code become one. Counts add up, keys keep first-seen order,
    different actions and all notes are joined. ``call`` orders the records. A record shows the first
    ``cap`` keys; ``merged_keys`` has them all."""
    bad = ~F.lower(F.trim("action")).isin(*ACTIONS) | (F.col("detected_count") < 0)
    checked = records.withColumn(
        "action", F.when(bad, F.raise_error(F.concat(F.lit("bad record for "), "code")).cast("string"))
        .otherwise(F.lower(F.trim("action"))))
    # Calls of one code are few; their keys may be many and stay rows until only the first are left.
    parts = F.sort_array(F.collect_list(F.struct("call", "action", "notes")))
    merged = checked.groupBy("code").agg(
        F.sum("detected_count").alias("detected_count"), parts.alias("_parts"), F.count(F.lit(1)).alias("merged_from_calls"))
    rank = F.row_number().over(W.partitionBy("code").orderBy("call", "place"))
    first = merged_keys(records).withColumn("_rank", rank).filter(F.col("_rank") <= cap).groupBy("code").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "row_key"))).alias("_keys"))
    return merged.join(first, "code", "left").select(
        "code", "detected_count",
        F.concat_ws("+", F.array_distinct(F.transform("_parts", lambda p: p["action"]))).alias("action"),
        F.coalesce(F.transform("_keys", lambda k: k["row_key"]), F.array().cast("array<string>")).alias("affected_keys"),
        F.concat_ws(" | ", F.filter(
            F.transform("_parts", lambda p: p["notes"]), lambda n: n != "")).alias("notes"),
        "merged_from_calls")


def merged_keys(records: DataFrame) -> DataFrame:
    """code, row_key and the call and place where it was seen first: every key of merged records, a row each."""
    each = records.select("code", "call", F.posexplode("affected_keys").alias("place", "row_key"))
    return each.groupBy("code", "row_key").agg(F.min(F.struct("call", "place")).alias("_at")).select("code", "row_key", "_at.*")


def coverage(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each catalogued class with its verdict, in catalogue order."""
    recorded = F.col("detected_count").isNotNull()
    expected, found = F.col("expected_count"), F.coalesce("detected_count", F.lit(0))
    off = recorded & expected.isNotNull() & (F.col("detected_count") != expected)
    return catalog.join(F.broadcast(ledger), "code", "left").select(
        "position", "code", "dataset", "severity", "title", "expected_count",
        found.alias("detected_count"), F.coalesce("action", F.lit("-")).alias("action"),
        F.when(~recorded, "NOT DETECTED").when(off, "MISMATCH").otherwise("OK").alias("status"),
        F.when(~recorded, "NEVER RECORDED").when(off, "COUNT MISMATCH").alias("problem"),
        F.when(off, F.col("detected_count") - expected).alias("delta"),
        F.when(~recorded | (expected.isNull() & (found == 0)), "missing")
        .when(expected.isNull() | (found == expected), "match").otherwise("mismatch").alias("board_status"),
    )


def coverage_check(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Only the problems; an empty result is the pass."""
    return coverage(catalog, ledger).filter("problem is not null").select(
        "code", "dataset", "problem", "expected_count", "detected_count", "delta")


def assert_covered(catalog: DataFrame, ledger: DataFrame) -> None:
    problems = coverage_check(catalog, ledger).collect()  # at most one row per catalogued class
    if problems:
        raise AssertionError([(r.code, r.problem, r.delta) for r in problems])


def audit_totals(catalog: DataFrame, ledger: DataFrame, quarantine: DataFrame) -> DataFrame:
    """E5: one row of totals."""
    held = quarantine.agg(F.count(F.lit(1))).scalar()
    return coverage(catalog, ledger).agg(
        F.count(F.lit(1)).alias("classes_in_catalog"),
        F.count_if(F.col("status") != "NOT DETECTED").alias("classes_detected"),
        F.count_if(F.col("status") == "NOT DETECTED").alias("classes_never_recorded"),
        F.sum("detected_count").alias("rows_affected"),
        F.count("problem").alias("mismatches"),
    ).withColumn("rows_quarantined", held)


def quarantine_dispositions(detections: DataFrame) -> DataFrame:
    """Rows of each slice by what became of them."""
    return detections.groupBy("dataset", "code", "disposition").agg(F.count(F.lit(1)).alias("slice_rows"))


def defect_listing(
    catalog: DataFrame, ledger: DataFrame, codes: tuple[str, ...] | None = None,
    dataset: str | None = None, severity: str | None = None, text: str = "",
    sort_by: str = "severity", descending: bool = False,
) -> DataFrame:
    """The catalogue filtered by code, dataset, severity and free text, then sorted."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(n)) for s, n in SEVERITY_RANK.items()])
    df = coverage(catalog, ledger).join(
        catalog.select("code", "detection", "decision"), "code").withColumn("severity_rank", rank)
    if codes is not None:
        df = df.filter(F.col("code").isin(*codes))
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if severity is not None:
        df = df.filter(F.col("severity") == severity)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "code", "title", "dataset", "detection", "decision", "action"))
        df = df.filter(hay.contains(text.strip().lower()))
    column = {
        "code": "code", "severity": "severity_rank", "dataset": "dataset",
        "expected": "expected_count", "detected": "detected_count"}[sort_by]
    key = F.col(column).desc() if descending else F.col(column).asc()
    return df.orderBy(key, F.col("code").asc())
