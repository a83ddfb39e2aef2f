"""Helpers that keep joins, windows and numbering safe when one key holds much of the data.

Nothing here trades rows for speed: every helper is exact for any key distribution.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager, nullcontext
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

# A table counted to have at most this many rows may be ordered in one task.
SMALL_ROWS = 200_000
# The JVM compiles no longer method than this, in bytes; a fused stage above it is run operator by operator.
LONGEST_METHOD = 8_000


_LOCAL_DIRS: dict[str, str] = {}  # one per local-mode session


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written intermediates that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without
    that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tillproof/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives Spark exact sizes for later joins.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with tidied(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value):
    """The session's ``name`` is ``value`` while open."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


_TIDYING: dict[str, tuple[int, str]] = {}  # open uses of a session, and its own setting
_TIDY_LOCK = threading.Lock()
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession):
    """While open, the shuffle files of a query are removed when it ends, not when the driver next collects its
    garbage. For writes: what they made is read from its table, and their shuffles never again. Threads may share it."""
    session = spark._jsparkSession.sessionUUID()
    with _TIDY_LOCK:
        depth, before = _TIDYING.get(session, (0, None))
        before = before if depth else spark.conf.get(TIDY, "false")
        _TIDYING[session] = (depth + 1, before)
        spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        with _TIDY_LOCK:
            depth, before = _TIDYING.pop(session)
            if depth > 1:
                _TIDYING[session] = (depth - 1, before)
            else:
                spark.conf.set(TIDY, before)


@contextmanager
def compiled(spark: SparkSession):
    """While open, stages too long for the JVM's compiler are not fused into one method."""
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", LONGEST_METHOD):
        yield


def bucketed(df: DataFrame, key: str, label: str, buckets: int | None = None, placed: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder in hash buckets of ``key``, sorted inside, and read it back.

    Tables with the same number of buckets meet on the key without a shuffle, however often. The rows
    move once, before the write, so every bucket is one file. Rows that come from a table in these buckets
    already are ``placed``: every bucket is read, and written, by one task, and none moves.
    """
    spark = df.sparkSession
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_folder(spark, label)
    name = "tillproof_" + path.rsplit("/", 1)[-1].replace("-", "_")
    if not placed:
        df = df.repartition(parts, key)
    # Without joins Spark would cut buckets into splits of its own.
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false") if placed else nullcontext(), tidied(spark):
        df.write.bucketBy(parts, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """True when ``df`` was counted to have at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", stored: bool = False) -> DataFrame:
    """Join rows to a side that is unique on ``keys``; both sides are read once.

    The side is written first, unless it is a ``stored`` table already, so Spark knows its size
    in bytes and broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``. A larger side
    is joined by sort and merge. Rows never fan out, so adaptive execution may cut the partition
    of a hot key, or of the rows without a key, into as many tasks as it needs.
    """
    return left.join(right if stored else written(right, "lookup"), keys, how)


def repeats(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(``order``) of every row but the first (by the unique column ``order``) of each equal group, written.

    Groups are counted with map-side combine, so a group of any size becomes one record per
    task. Rows are counted by a fingerprint first; only those that share one are compared by all
    columns, exactly and with nulls equal. Fingerprints and row numbers alone are moved for that, and the
    few rows to compare are fetched by their numbers; in a table bucketed by ``order`` the others stay.
    """
    absent = reduce(lambda a, b: a * 2 + b, [F.col(k).isNull().cast("long") for k in keys], F.lit(0).cast("long"))
    marks = ["_h1", "_h2"]
    prints = df.select(order, F.xxhash64(absent, *keys).alias("_h1"), F.xxhash64(*reversed(keys), absent, F.lit("second")).alias("_h2"))
    # 128 bits stand for the row in the large count. Rows that share them are grouped by their columns.
    shared = written(prints.groupBy(*marks).count().filter("count > 1").drop("count"), "shared")
    numbers = written(prints.join(shared, marks, "left_semi"), "shared-numbers")
    members = written(df.select(order, *keys).join(numbers.hint("shuffle_hash"), order), "members")
    groups = members.groupBy(*marks, *keys).agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    firsts = groups.withColumnsRenamed({c: f"_of_{c}" for c in (*marks, *keys)})
    equal = reduce(lambda a, b: a & b, [F.col(m) == F.col(f"_of_{m}") for m in marks] + [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return written(members.join(firsts, equal).filter(F.col(order) > F.col("_first")).select(order), "repeats")


def flag_repeats(
    df: DataFrame, keys: list[str], order: str, flag: str,
) -> DataFrame:
    """Mark the ``repeats`` among the rows. Only their numbers meet all rows, which look them up without
    being sorted or gathered while the numbers are few, and without being moved in a table bucketed by
    ``order``."""
    again = repeats(df, keys, order).select(F.col(order).alias("_repeat"))
    found = df.join(again, F.col(order) == F.col("_repeat"), "left")
    return found.select(*df.columns, F.col("_repeat").isNotNull().alias(flag))


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that has fewer partitions than there are cores one per core.

    A large scan already has more partitions than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Dense numbering in a total order without a one-partition window.

    Rows are range partitioned and sorted, written once so their places cannot change, and
    numbered by place in the partition plus the size of the partitions before it. The only
    single-task step is a running sum with one row per partition.
    """
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    fixed = written(ranged, f"numbered-{name}")
    part = F.shiftrightunsigned("_slot", 33)
    place = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("_size").over(
                W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).select("_part", "_before")
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_before") + place + F.lit(start)).cast("long"))
        .drop("_part", "_slot", "_before")
    )
