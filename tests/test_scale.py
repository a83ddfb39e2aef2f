"""Exactness of the helpers when one key holds most rows."""

import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from kit import CONFIG, TRANSACTIONS, dims, flagged, raw
from tillproof import scale
from tillproof.operators import star as X, transactions as T
from tillproof.operators.medians import group_median
from tillproof.sources import sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows, two thirds of them under one key."""
    return spark.range(30_000).select(
        F.col("id").alias("source_row"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("key"))


def scans(df, name):
    return str(df._jdf.queryExecution().executedPlan()).count(name)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_lookup_equals_broadcast_and_reads_once(spark, skewed, no_broadcast):
    side = skewed.select("key").distinct().filter("key <> 'k7'").withColumn("v", F.length("key"))
    left = scale.written(skewed, "t-left")
    merged = scale.lookup(left, side, ["key"])
    plain = left.join(F.broadcast(side), "key", "left")
    assert merged.columns == plain.columns and "SortMergeJoin" in merged._jdf.queryExecution().toString()
    assert scans(merged, "t-left") == 1
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_rows_without_a_key_are_kept(spark, no_broadcast):
    left = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"))
    side = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    got = scale.lookup(left, side, ["k"])
    assert got.count() == 1000 and got.filter("v is null").count() == 500


def test_chained_lookups_read_the_feed_once(spark, no_broadcast):
    stores, products = dims(spark)
    table = scale.written(raw(spark, "transactions", TRANSACTIONS), "t-feed")
    chained = T.flag_orphans(T.flag_orphans(table, stores, "store_id", "store_id", "a"), products, "product_id", "product_id", "b")
    assert scans(chained, "t-feed") == 1
    sales = scale.written(T.clean_transactions(flagged(spark), CONFIG), "t-sales")
    tables = {"dim_date": X.dim_date(sales, CONFIG), "dim_store": X.dim_store(stores), "dim_product": X.dim_product(products),
              "dim_customer": X.dim_customer(sales, CONFIG)}
    stored = {n: scale.written(df, f"t-{n}") for n, df in tables.items()}
    fact = X.fact_rows(sales, stored)
    assert scans(fact, "t-sales") == 1 and fact.count() == sales.count()


def test_flag_repeats_keeps_exactly_the_first(spark, skewed):
    got = scale.flag_repeats(skewed, ["key"], "source_row", "again")
    kept = {r.key: r.source_row for r in got.filter("not again").collect()}
    first = {r.key: r.f for r in skewed.groupBy("key").agg(F.min("source_row").alias("f")).collect()}
    assert kept == first and got.count() == 30_000


def test_flag_repeats_groups_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "source_row long, key string")
    assert {r.source_row for r in scale.flag_repeats(df, ["key"], "source_row", "again").filter("again").collect()} == {2}


def test_number_rows_is_dense_and_ordered(spark, skewed):
    got = scale.number_rows(skewed.repartition(7), ["key", "source_row"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 30_001))
    assert [(r.key, r.source_row) for r in got] == sorted((r.key, r.source_row) for r in got)


def test_group_median_matches_statistics(spark):
    dice = random.Random(5)
    data = [(g, round(dice.choice([dice.uniform(0, 3), dice.uniform(0, 500)]), 2)) for g in "abcd" for _ in range(dice.choice([1, 2, 7, 200]))]
    df = spark.createDataFrame(data, "g string, v double").select("g", F.col("v").cast("decimal(18,2)").alias("v"))
    want = {g: statistics.median([v for h, v in data if h == g]) for g in {g for g, _ in data}}
    for r in group_median(df, ["g"], "v", "m").collect():
        assert abs(float(r.m) - want[r.g]) <= 0.0051


def test_medians_of_all_sizes_and_signs(spark):
    dice = random.Random(6)
    data = [("a", dice.randrange(-10**9, 10**9)) for _ in range(301)] + [("b", dice.randrange(10**14)) for _ in range(40)] + [("c", 7)] * 9 + [("d", -1), ("d", 4)]
    df = spark.createDataFrame([(g, c) for g, c in data], "g string, c long").select("g", (F.col("c") / 100).cast("decimal(18,2)").alias("v"))
    want = {g: statistics.median([c for h, c in data if h == g]) / 100 for g in "abcd"}
    got = {r.g: float(r.m) for r in group_median(df, ["g"], "v", "m").collect()}
    assert set(got) == set(want) and all(abs(got[g] - want[g]) <= 0.0051 for g in want)
    assert group_median(df.limit(0), ["g"], "v", "m").collect() == []


def test_a_median_of_very_many_values_orders_only_histograms(spark):
    """Ten million distinct values in one group: no window without a partition, none over the values."""
    df = spark.range(10_000_000).select(F.lit(1).alias("g"), (F.col("id") * 37 % 10_000_000 / 100).cast("decimal(18,2)").alias("v"))
    found = group_median(df, ["g"], "v", "m")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Window") >= 1
    assert float(found.first().m) == 50_000.00  # of 0.00 to 99,999.99 the mean of 49,999.99 and 50,000.00, rounded


def test_flag_repeats_keeps_cells_apart(spark):
    """Cells that hold separators, blanks or nothing make rows unequal, whatever their joined text is."""
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), ("\x00", "x"), (None, "x"), (None, None), ("", None), (None, ""), ("a\x1fb", "c"), (None, "x"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "source_row long, a string, b string")
    assert {r.source_row for r in scale.flag_repeats(df, ["a", "b"], "source_row", "again").filter("again").collect()} == {7, 8, 9}


def test_rows_that_share_a_fingerprint_are_compared(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    df = spark.createDataFrame([(i, "xyz"[i % 3], i % 2) for i in range(12)], "source_row long, a string, b int")
    got = {r.source_row for r in scale.flag_repeats(df, ["a", "b"], "source_row", "again").filter("again").collect()}
    monkeypatch.setattr(F, "xxhash64", real)
    assert got == set(range(6, 12))


def test_bucketed_tables_meet_without_a_shuffle(spark, no_broadcast):
    a, b = (scale.bucketed(spark.range(1000).select("id", F.lit(n).alias(n)), "id", n, 4) for n in ("left", "right"))
    both = a.join(b, "id", "full")
    assert both.count() == 1000 and "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_placed_rows_are_written_where_they_lie(spark, no_broadcast):
    rows = scale.bucketed(spark.range(1000).select("id", (F.col("id") % 7).alias("v")), "id", "t-placed-from", 4)
    kept = scale.bucketed(rows.filter("v <> 3"), "id", "t-placed", 4, placed=True)
    assert len(kept.inputFiles()) == 4 and kept.count() == 857
    both = rows.join(kept.withColumnRenamed("v", "w"), "id", "left")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.filter("w is null").count() == 143 and both.filter("w <> v").count() == 0


def test_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Other:
        master = "yarn"
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = Other()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scale.shared_dir(Session())


def test_the_folder_the_cluster_names_is_used():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: "hdfs://shared/checkpoints/")})()
    assert scale.shared_dir(Session()) == "hdfs://shared/checkpoints"


def test_written_tables_are_read_back_whole(spark):
    df = scale.written(spark.range(5), "five")
    assert df.count() == 5 and all("/tillproof/" in f for f in df.inputFiles())


def test_rows_meet_only_the_numbers_of_repeats(spark):
    """The last join looks up row numbers, not whole rows, so few repeats are broadcast and no row moves."""
    df = scale.written(spark.range(4_000).select(F.col("id").alias("source_row"), *[(F.col("id") % 3_900).cast("string").alias(c) for c in "ab"]), "t-rows")
    found = scale.flag_repeats(df, ["a", "b"], "source_row", "again")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [source_row" in plan and "hashpartitioning" not in plan and "_h1" not in plan
    assert sorted(r.source_row for r in found.filter("again").collect()) == list(range(3_900, 4_000))


def test_marks_of_rows_are_looked_up_where_the_rows_lie(spark, no_broadcast):
    """Copies and orphans are found by row numbers and ids; of the whole rows, bucketed by number, none moves."""
    rows = scale.bucketed(raw(spark, "transactions", [*TRANSACTIONS, TRANSACTIONS[0], TRANSACTIONS[5]]), "source_row", "t-raw-rows", 4)
    found = T.flag_transactions(rows, *dims(spark), CONFIG)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.source_row: (r.is_copy, r.orphan_store, r.orphan_product) for r in found.collect()} == {
        **{i: (False, False, False) for i in range(5)}, 5: (False, True, False), 6: (True, False, False), 7: (True, True, False)}


def test_a_stage_too_long_for_the_compiler_is_not_fused(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with scale.compiled(spark):
        assert int(spark.conf.get(name)) == 8_000
    assert spark.conf.get(name) == before


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    def settled(before):
        for _ in range(50):  # executors remove them in their own time
            if not held() - before:
                return True
            time.sleep(0.1)
        return False

    rows = spark.range(3000).select((F.col("id") % 700).alias("k"), F.col("id").alias("source_row"))
    grouped, before = rows.groupBy("k").count(), held()
    table = scale.written(grouped, "t-tidy")
    assert settled(before)
    buckets = scale.bucketed(rows, "source_row", "t-tidy-buckets", 4)
    assert settled(before)
    seen = sinks.write_tables({"a": grouped, "b": rows.groupBy("source_row").count()}, str(tmp_path))[1]
    assert settled(before) and seen == {"a": 700, "b": 3000} and spark.conf.get(scale.TIDY) == "false"
    assert table.count() == 700 and buckets.count() == 3000
    # A frame made meanwhile still gives its rows, as often as it is asked.
    with scale.tidied(spark), scale.tidied(spark):
        shared = rows.groupBy("k").count()
        assert len(shared.collect()) == len(shared.collect()) == 700
    assert len(shared.collect()) == 700 and spark.conf.get(scale.TIDY) == "false"
