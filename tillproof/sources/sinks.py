"""Writers: CSV, JSON, quarantine slices and the published star."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tillproof.scale import tidied


def write_csv(df: DataFrame, path: str) -> str:
    """A3: a table as CSV with a header; no index column is added."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return path


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, dates to ISO text, so every value is valid JSON."""
    out: dict[str, Column] = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            out[field.name] = F.when(~bad, c)
        elif isinstance(field.dataType, T.DateType):
            out[field.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.ArrayType):
            out[field.name] = F.sort_array(c)
    return df.withColumns(out) if out else df


def write_json(df: DataFrame, path: str) -> str:
    """A4: one JSON object per line."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def table_records(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """A5: the first rows of a table, in a stated order, as JSON text records."""
    safe = json_safe(df).orderBy(*order).limit(limit)
    return safe.select(
        *order,
        F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("record"))


def merge_slices(slices: list[DataFrame]) -> DataFrame:
    """Slices of one ledger under one another; a column a slice lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), slices)


def quarantine_sink(slices: list[DataFrame], path: str, mode: str = "append") -> str:
    """Slices stored by dataset and reason code; repeated calls add rows."""
    merge_slices(slices).write.mode(mode).partitionBy("dataset", "reason_code").option(
        "header", True).csv(path)
    return path


def lineage_sink(lineage: DataFrame, path: str) -> str:
    """The row ledger, written where the caller says."""
    lineage.write.mode("overwrite").parquet(path)
    return path


STAR_TABLES = ("dim_date", "dim_store", "dim_product", "dim_customer", "fact_sales")


def write_tables(tables: dict[str, DataFrame], path: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Write independent tables under ``path`` side by side; the tables as read back, and the rows that
    each write saw. Rows are observed in the stage that writes them, so a count needs no other pass."""
    spark = next(iter(tables.values())).sparkSession

    @inheritable_thread_target(spark)
    def write(item: tuple[str, DataFrame]) -> int:
        name, df = item
        seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}")
        return seen.get["rows"]

    with tidied(spark), ThreadPoolExecutor(len(tables)) as pool:
        counts = list(pool.map(write, tables.items()))
    return ({name: spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in tables.items()},
            dict(zip(tables, counts)))


POINTER = "CURRENT"


def staging_folder(target: str) -> str:
    """A new version's folder inside ``target``: the same file system, and no part of the
    published star until the pointer names it."""
    return f"{target.rstrip('/')}/v-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and the path itself, as the JVM has them."""
    goal = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return goal.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), goal


def _switch(spark: SparkSession, written: str, pointer: str) -> None:
    """Rename one small file over another, in one step."""
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    (_, source), (_, goal) = _hadoop(spark, written), _hadoop(spark, pointer)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(source), context.makeQualified(goal), how)


def publish(spark: SparkSession, staged: str, target: str) -> str:
    """Make ``staged``, a version folder inside ``target``, the published star.

    The pointer to the version is written aside and renamed over the old one last. Readers find
    the old star or the new one whole; if any step fails, the pointer still names the old one.
    """
    folder, _, version = staged.rpartition("/")
    if folder != target.rstrip("/"):
        raise ValueError(f"{staged} is not a version of {target}")
    fs, goal = _hadoop(spark, staged)
    if not fs.exists(goal):
        raise FileNotFoundError(f"nothing staged at {staged}")
    aside = f"{folder}/.{version}.pointer"
    fs, path = _hadoop(spark, aside)
    out = fs.create(path, True)
    try:
        out.write(bytearray(version, "utf-8"))
    finally:
        out.close()
    _switch(spark, aside, f"{folder}/{POINTER}")
    return target


def published_version(spark: SparkSession, path: str) -> str:
    """The folder of the version that ``path`` publishes."""
    fs, goal = _hadoop(spark, f"{path.rstrip('/')}/{POINTER}")
    if not fs.exists(goal):
        raise FileNotFoundError(f"no star is published at {path}")
    found = fs.open(goal)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
    finally:
        found.close()
    return f"{path.rstrip('/')}/{name.strip()}"


def read_star(spark: SparkSession, path: str, views: bool = False) -> dict[str, DataFrame]:
    """The published tables, as frames and optionally as temp views."""
    version = published_version(spark, path)
    tables = {name: spark.read.parquet(f"{version}/{name}") for name in STAR_TABLES}
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables
