"""Text tables in, with the place of every row in its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from tillproof.functions.text import tokens_to_null
from tillproof.scale import SMALL_ROWS, lookup, written
from tillproof.schemas import RAW_SCHEMAS, require_columns


def read_text_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None,
    keep_blank_as_na: bool = True, multi_line: bool = False,
) -> DataFrame:
    """A1: every column as text, nothing trimmed; NA tokens become null unless kept.

    Without a schema the header line alone names the columns. A missing path raises.
    """
    reader = (
        spark.read.option("header", True).option("inferSchema", False)
        .option("mode", "FAILFAST").option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"').option("enforceSchema", False)
        .option("nullValue", "").option("emptyValue", "")
    )
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    if not keep_blank_as_na:
        return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])
    return df.select(*[tokens_to_null(F.col(c)).alias(c) for c in df.columns])


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A2: the three named datasets; raises if any is absent or lacks a column."""
    feed = {}
    for name, schema in RAW_SCHEMAS.items():
        df = read_text_csv(spark, f"{folder}/{name}.csv", schema)
        require_columns(df, schema.names, name)
        feed[name] = df
    return feed


def with_source_row(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Give a CSV scan a 0-based ``source_row`` in file order, without sorting or shuffling it.

    A row's place is its place inside its file block plus the rows of earlier blocks. The
    scan is written once with a per-task counter, so both passes see the same counter; the
    only one-task step is a running sum with one row per file block.
    """
    blocks = ["_file", "_start"]
    fixed = written(
        df.select(
            "*", F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_slot")),
        f"source-{label}")
    sizes = fixed.groupBy(*blocks).agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("_size").over(
                W.orderBy(*blocks).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_size")
    return (
        lookup(fixed, before, blocks, "inner")
        .withColumn("source_row", (F.col("_before") + F.col("_slot") - F.col("_first")).cast("long"))
        .drop("_slot", "_first", "_before", *blocks)
    )


def parquet_with_row_place(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """Parquet scan with the 0-based place of each row, from the reader's own row index.

    Rows of several files continue in path order; one row per file is summed for that.
    """
    df = spark.read.parquet(path)
    files = len(df.inputFiles())
    rows = df.select("*", F.col("_metadata.row_index").alias(name),
                     F.col("_metadata.file_path").alias("_file"))
    if files <= 1:
        return rows.drop("_file")
    before = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size")).select(
        "_file",
        F.coalesce(
            F.sum("_size").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)).alias("_before"))
    # One row per file, and the driver has the count of files.
    side = F.broadcast(before) if files <= SMALL_ROWS else before
    return rows.join(side, "_file").withColumn(
        name, (F.col(name) + F.col("_before")).cast("long")).drop("_file", "_before")
