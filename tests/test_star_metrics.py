import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kit import CONFIG, dims, flagged, rows, sale
from tillproof.operators import adhoc, metrics as M, star as X, transactions as T
from tillproof.operators.constraints import constraint_suite
from tillproof.scale import new_folder
from tillproof.sources import sinks
from tillproof.sources.sinks import read_star


@pytest.fixture(scope="module")
def parts(spark):
    sales = [
        sale(1, total="20.00"), sale(2, q="3", price="100.00", total="270.00", product="P002"),
        sale(3, q="-1", price="100.00", total="-100.00", product="P002", store="S002"),
        sale(4, customer=None, q="1", price="100.00", total="100.00", store="S002", day="2026-04-02")]
    table = flagged(spark, sales)
    return (*dims(spark), T.clean_transactions(table, CONFIG))


@pytest.fixture(scope="module")
def star(spark, parts):
    path = new_folder(spark, "t-star")
    X.load_star(*parts, CONFIG, path)
    return read_star(spark, path)


def test_calendar_is_dense_to_as_of(star):
    days = star["dim_date"]
    assert days.count() == (dt.date(2026, 6, 2) - dt.date(2026, 4, 2)).days + 1
    assert days.agg(F.max("full_date")).first()[0] == dt.date(2026, 6, 2)


def test_empty_feed_has_no_calendar(spark, parts):
    with pytest.raises(Exception, match="no transactions"):
        X.dim_date(parts[2].limit(0), CONFIG).collect()


def test_keys_are_dense_in_natural_order(star):
    assert rows(star["dim_store"], "store_key", "store_id") == [(1, "S001"), (2, "S002"), (3, "S003")]
    assert rows(star["fact_sales"], "sales_key", "transaction_id") == [(1, "T1"), (2, "T2"), (3, "T3"), (4, "T4")]
    assert rows(star["dim_customer"], "customer_id", "is_guest") == [("C1", 0), ("GUEST", 1)]


def test_guest_exists_even_when_no_one_is(spark, parts):
    named = parts[2].filter("not is_guest")
    assert rows(X.dim_customer(named, CONFIG), "customer_id") == [("C1",), ("GUEST",)]


def test_contradictory_guest_flag_stops(spark, parts):
    bad = parts[2].withColumn("is_guest", F.col("transaction_id") == "T1")
    with pytest.raises(Exception, match="contradictory"):
        X.customers(bad, CONFIG).collect()


def test_unknown_key_and_repeated_key_stop(spark, parts, star):
    lost = parts[2].withColumn("store_id", F.lit("S404"))
    with pytest.raises(Exception, match="no store_key"):
        X.fact_rows(lost, star).collect()
    assert X.unresolved(lost, star["dim_store"], "store_id", "store_id").count() == 4
    with pytest.raises(ValueError, match="repeats"):
        X.dim_store(parts[0].unionByName(parts[0]))
    with pytest.raises(ValueError, match="repeats"):
        X.fact_sales(parts[2].unionByName(parts[2]), star)


def test_good_star_breaks_no_constraint(star):
    assert constraint_suite(star).filter("violations > 0").count() == 0


@pytest.mark.parametrize("change,name", [
    (lambda s: {**s, "fact_sales": s["fact_sales"].withColumn("quantity", F.col("quantity") * -1)}, "return_sign_of_quantity"),
    (lambda s: {**s, "fact_sales": s["fact_sales"].withColumn("store_key", F.lit(99).cast("long"))}, "store_key"),
    (lambda s: {**s, "dim_store": s["dim_store"].withColumn("zip_code", F.lit("1"))}, "zip_is_five"),
    (lambda s: {**s, "dim_date": s["dim_date"].withColumn("is_weekend", F.lit(1))}, "weekend_agrees"),
    (lambda s: {**s, "fact_sales": s["fact_sales"].unionByName(s["fact_sales"])}, "transaction_id"),
    (lambda s: {**s, "fact_sales": s["fact_sales"].withColumn("extended_amount", F.col("extended_amount") + 1)}, "extended_agrees"),
])
def test_each_damage_is_named(star, change, name):
    broken = {r.constraint_name for r in constraint_suite(change(star)).filter("violations > 0").collect()}
    assert name in broken


def test_the_fact_is_read_once_to_verify_and_twice_for_constraints(star, parts):
    plan = X.verify_star(star, *parts)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "net_amount#" in line for line in plan.splitlines()) == 1
    plan = constraint_suite(star)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [" in line and "sales_key#" in line for line in plan.splitlines()) == 2


def test_null_and_repeated_keys_are_counted(star):
    fact = star["fact_sales"].withColumn("store_key", F.when(F.col("sales_key") > 1, F.col("store_key"))).withColumn("transaction_id", F.lit("T1"))
    got = {(r.kind, r.constraint_name): r.violations for r in constraint_suite({**star, "fact_sales": fact}).filter("violations > 0").collect()}
    assert got == {("fk", "store_key"): 1, ("not_null", "store_key"): 1, ("unique", "transaction_id"): 1}


def test_a_load_with_unknown_keys_leaves_them_readable(spark, parts):
    lost = parts[2].withColumn("store_id", F.when(F.col("transaction_id") == "T2", "S404").otherwise(F.col("store_id"))).withColumn(
        "product_id", F.when(F.col("transaction_id").isin("T2", "T3"), "P404").otherwise(F.col("product_id")))
    path = new_folder(spark, "t-lost")
    with pytest.raises(X.UnresolvedKeys, match="2 sales rows") as stop:
        X.load_star(parts[0], parts[1], lost, CONFIG, path)
    kept = X.read_outcome(spark, stop.value.path, "unresolved")
    assert rows(kept, "transaction_id", "store_id", "missing_keys") == [("T2", "S404", "store_key,product_key"), ("T3", "S002", "product_key")]
    with pytest.raises(FileNotFoundError):
        read_star(spark, path)


def test_a_table_that_reads_back_short_is_not_published(spark, parts, monkeypatch):
    real = X.build_star
    monkeypatch.setattr(X, "build_star", lambda *a: (lambda s, n: (s, {**n, "dim_date": n["dim_date"] + 1}))(*real(*a)))
    with pytest.raises(ValueError, match="failed verification"):
        X.load_star(*parts, CONFIG, new_folder(spark, "t-short"))


def test_failed_verification_publishes_nothing(spark, parts, monkeypatch):
    real = X.build_star
    monkeypatch.setattr(X, "build_star", lambda *a: (lambda s, n: ({**s, "fact_sales": s["fact_sales"].limit(2)}, n))(*real(*a)))
    path = new_folder(spark, "never")
    with pytest.raises(ValueError, match="failed verification"):
        X.load_star(*parts, CONFIG, path)
    with pytest.raises(Exception):
        read_star(spark, path)


def test_a_failed_publish_leaves_the_old_star(spark, parts, monkeypatch):
    path = new_folder(spark, "t-publish")
    X.load_star(*parts, CONFIG, path)
    before = sinks.published_version(spark, path)
    two = (parts[0], parts[1], parts[2].filter("transaction_id <> 'T4'"))
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "_switch", lambda *a: (_ for _ in ()).throw(OSError("rename failed")))
        with pytest.raises(OSError):
            X.load_star(*two, CONFIG, path)
    assert sinks.published_version(spark, path) == before and read_star(spark, path)["fact_sales"].count() == 4
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, sinks.staging_folder(path), path)
    with pytest.raises(ValueError):
        sinks.publish(spark, new_folder(spark, "elsewhere"), path)
    held = read_star(spark, path)["fact_sales"]
    X.load_star(*two, CONFIG, path)
    # Whoever has the old version open reads on; new readers get the new one.
    assert held.count() == 4 and read_star(spark, path)["fact_sales"].count() == 3


def test_reconciliation_can_fail(spark, star):
    good = M.run_metric(spark, M.RECONCILIATION, star, CONFIG).first()
    assert (good.gross_sales, good.discount_total, good.returns_total, good.net_revenue) == (420.0, 30.0, -100.0, 290.0)
    assert str(good.line_level_delta) == str(good.aggregate_delta) == "0.0"
    bad = {**star, "fact_sales": star["fact_sales"].withColumn(
        "net_amount", F.when(F.col("transaction_id") == "T1", F.col("net_amount") + Decimal("5.00")).otherwise(F.col("net_amount")))}
    off = M.run_metric(spark, M.RECONCILIATION, bad, CONFIG).first()
    assert (off.line_level_delta, off.aggregate_delta) == (-5.0, -5.0)


def test_window_has_both_ends(spark, parts, star):
    days = ["2026-05-03", "2026-05-04", "2026-06-02"]
    table = flagged(spark, [sale(i, day=d) for i, d in enumerate(days)])
    path = new_folder(spark, "t-window")
    X.load_star(parts[0], parts[1], T.clean_transactions(table, CONFIG), CONFIG, path)
    assert M.run_metric(spark, M.TOP_STORES, read_star(spark, path), CONFIG).first().transaction_count == 2


def test_metrics_by_hand(spark, star):
    got = M.run_metrics(spark, star, CONFIG)
    assert [tuple(r) for r in got["aov_by_region"].collect()] == [("Northeast", 2, 290.0, 145.0), ("West", 1, 100.0, 100.0)]
    assert [tuple(r) for r in got["top_customers_lifetime"].collect()] == [("C1", 3, 190.0, 63.33)]
    west = {r.store_id: r for r in got["return_rate_by_store"].collect()}["S002"]
    assert (west.unit_return_rate_pct, west.above_alert) == (50.0, 1)
    growth = {(r.category, r.year_month): r for r in got["mom_growth_by_category"].collect()}
    assert growth[("Apparel", "2026-05")].growth_pct == -80.0 and growth[("Apparel", "2026-04")].growth_pct is None
    dense = {(r.category, r.year_month): r for r in M.mom_growth_dense(spark, star, CONFIG).collect()}
    assert len(dense) == 6 and dense[("Home", "2026-04")].net_revenue == 0.0
    sla = {r.store_id: r for r in adhoc.return_sla_breaches(star).collect()}["S002"]
    assert (sla.return_rate_pct, sla.sla_status) == (100.0, "BREACH")


def test_registry_rules():
    M.check_registry()
    wrong = M.Metric("x", "t", "n", {"rate_pct": "ratio"}, "")
    with pytest.raises(ValueError, match="disagree"):
        M.check_registry({**M.METRICS, "x": wrong})
    with pytest.raises(ValueError, match="missing"):
        M.check_registry({}, ("aov_by_region",))
