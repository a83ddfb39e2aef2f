from decimal import Decimal

import pytest

from kit import CONFIG, PRODUCTS, STORES, TRANSACTIONS, by, flagged, raw, rows, sale
from tillproof.config import RunConfig
from tillproof.operators import products as P, stores as S, transactions as X
from tillproof.plans.workspace import Workspace


def test_stores_are_padded_filled_and_flagged(spark):
    got = by(S.clean_stores(raw(spark, "stores", STORES), CONFIG), "store_id")
    assert (got["S002"].zip_code, got["S002"].zip_is_suspect) == ("00938", True)
    assert (got["S002"].region, got["S002"].region_is_imputed) == ("West", True)
    assert got["S001"].region_is_imputed is False


def test_region_comes_only_from_words_the_column_uses(spark):
    lone = [STORES[0], ("S9", "Far", "Bend", "OR", "97001", None, "2012-01-01")]
    assert by(S.clean_stores(raw(spark, "stores", lone), CONFIG), "store_id")["S9"].region == "Unknown"
    known = [*lone, ("S8", "Sun", "Mesa", "AZ", "85201", "West", "2012-01-01")]
    assert by(S.clean_stores(raw(spark, "stores", known), CONFIG), "store_id")["S9"].region == "West"


def test_state_with_two_labels_stops(spark):
    clash = [STORES[2], ("S9", "Far", "Bend", "OR", "97001", "South", "2012-01-01")]
    with pytest.raises(Exception, match="two labels"):
        S.clean_stores(raw(spark, "stores", clash), CONFIG).collect()


NEAR = [
    ("S7", "Rochester Downtown", "Rochester", "NY", "14604", "Northeast", "2006-01-22"),
    ("S7", "Downtown Rochester", "Rochester", "NY", "14604", "Northeast", "2006-01-22"),
]


@pytest.mark.parametrize("order", [NEAR, NEAR[::-1]])
def test_survivor_does_not_depend_on_row_order(spark, order):
    df = S.prepared_stores(raw(spark, "stores", order))
    assert rows(S.survivorship_ranked(df, "store_id", S.store_criteria()), "store_name") == [("Downtown Rochester",)]
    assert {r.decided_by for r in S.survivorship_evidence(df, "store_id", S.store_criteria()).collect()} == {"first_store_name"}


def test_survivor_prefers_fewer_nulls_then_earlier_date(spark):
    holes = [("S1", "A", None, "NY", "14604", "Northeast", "2000-01-01"), ("S1", "B", "Rome", "NY", "14604", "Northeast", "2009-01-01")]
    df = S.prepared_stores(raw(spark, "stores", holes))
    ev = by(S.survivorship_evidence(df, "store_id", S.store_criteria()), "store_name")
    assert (ev["B"].verdict, ev["A"].verdict, ev["A"].decided_by) == ("ELECTED", "REJECTED", "fewest_nulls")
    dates = [("S1", "A", "R", "NY", "14604", "N", "2009-01-01"), ("S1", "B", "R", "NY", "14604", "N", "bad"), ("S1", "C", "R", "NY", "14604", "N", "2001-01-01")]
    df = S.prepared_stores(raw(spark, "stores", dates))
    assert rows(S.survivorship_ranked(df, "store_id", S.store_criteria()), "store_name") == [("C",)]


def test_exact_copies_go_before_conflicts(spark):
    got = by(P.clean_products(raw(spark, "products", PRODUCTS), CONFIG), "product_id")
    assert len(got) == 3 and got["P002"].price_conflict is False
    assert (got["P003"].category, got["P003"].category_is_imputed) == ("Unknown", True)


@pytest.mark.parametrize("prices", [("141.61", "150.11"), ("150.11", "141.61")])
def test_price_conflict_takes_the_highest(spark, prices):
    data = raw(spark, "products", [("P5", "X", "Home", prices[0], "V"), ("P6", "Y", "Home", "9.00", "V"), ("P5", "X", "Home", prices[1], "V")])
    got = by(P.clean_products(data, CONFIG), "product_id")["P5"]
    assert (got.list_unit_price, got.price_conflict) == (Decimal("150.11"), True)
    ev = by(P.conflict_evidence(data), "unit_price")
    assert ev["150.11"].is_elected and not ev["141.61"].is_elected
    assert ev["141.61"].price_delta == Decimal("8.50") and ev["141.61"].conflicting_columns == "unit_price"


def test_conflict_fills_other_columns_from_the_first_value(spark):
    data = raw(spark, "products", [("P5", None, "Home", "1.00", "V"), ("P5", "Late", "Toys", "1.00", "V")])
    got = P.resolve_conflicts_by_policy(data).first()
    assert (got.product_name, got.category, got.conflicting_columns) == ("Late", "Home", "product_name,category")
    assert got.price_conflict is False


def test_zero_price_takes_median_of_its_own_category(spark):
    prices = [("A1", "x", "Apparel", p, "V") for p in ("100", "120", "140")]
    prices = [(f"A{i}", *r[1:]) for i, r in enumerate(prices)] + [("Z", "z", "Apparel", "0.00", "V"), ("B", "b", "Home", "900", "V"), ("N", "n", None, None, "V")]
    got = by(P.clean_products(raw(spark, "products", prices), CONFIG), "product_id")
    assert (got["Z"].list_unit_price, got["Z"].price_is_imputed) == (Decimal("120.00"), True)
    assert got["N"].list_unit_price == Decimal("130.00")  # no category: all valid prices


def test_each_row_has_one_outcome(spark):
    got = by(flagged(spark), "transaction_id")
    assert {k: (v.disposition, v.reason_code) for k, v in got.items()} == {
        "T1": ("kept", None), "T2": ("kept", None), "T3": ("kept", None), "T4": ("quarantined", "TX-08"),
        "T5": ("quarantined", "TX-07"), "T6": ("quarantined", "TX-04")}
    assert got["T2"].is_return and got["T3"].customer == "GUEST" and got["T3"].is_guest


def test_copies_are_found_on_raw_text_and_first_stays(spark):
    data = [sale(1), sale(2), sale(1), sale(1), ("T1", *sale(1)[1:7], "20.0")]
    got = flagged(spark, data)
    assert rows(got.filter("is_copy"), "source_row") == [(2,), (3,)]
    assert rows(X.id_collisions(raw(spark, "transactions", data), "transaction_id")) == [("T1", 2, 4)]


def test_precedence_and_full_masks(spark):
    data = [sale(1, store="S999", product="P999", q="0", total="0", day="2026-07-01")]
    got = flagged(spark, data)
    assert got.first().reason_code == "TX-07"
    assert {r.reason_code for r in X.quarantine_view(got).collect()} == {"TX-04", "TX-05", "TX-07", "TX-08"}


def test_null_key_is_an_orphan_and_as_of_day_is_not_future(spark):
    got = by(flagged(spark, [sale(1, store=None), sale(2, day="2026-06-02"), sale(3, day="2026-06-03")]), "transaction_id")
    assert (got["T1"].reason_code, got["T2"].reason_code, got["T3"].reason_code) == ("TX-04", None, "TX-08")
    assert got["T3"].days_ahead == 1


def test_discount_is_exposed_and_total_kept(spark):
    got = by(flagged(spark, [sale(1, q="3", price="100.00", total="270.00"), sale(2, total="$20.00")]), "transaction_id")
    assert (got["T1"].has_discount, got["T1"].discount_amount, got["T1"].parsed_total_amount) == (True, Decimal("30.00"), Decimal("270.00"))
    assert got["T2"].currency_formatted and not got["T2"].has_discount


def test_unread_values_are_held_not_zeroed(spark):
    got = by(flagged(spark, [sale(1, total="n/a"), sale(2, q="2.7")]), "transaction_id")
    assert got["T1"].reason_code == got["T2"].reason_code == "TX-02"


def test_unread_date_stops_a_strict_run(spark):
    table = flagged(spark, [sale(1, day="someday")])
    with pytest.raises(ValueError, match="unread transaction date"):
        X.clean_transactions(table, CONFIG)
    assert X.clean_transactions(table, RunConfig(strict_dates=False)).count() == 0


def test_budget_adds_up(spark):
    table = flagged(spark, TRANSACTIONS + [sale(1)])
    row = X.check_budget(table).first()
    assert (row.source_rows, row.kept, row.dropped, row.quarantined) == (7, 3, 1, 3)
    assert sum(r.source_rows for r in X.row_budget(table).collect()) == 7
    assert X.lineage(table).count() == 7


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="zip_code"):
        S.clean_stores(raw(spark, "stores", STORES).drop("zip_code"), CONFIG)


def test_rows_without_a_key_are_held_back(spark):
    shops = raw(spark, "stores", STORES + [(None, "A", "Rome", "NY", "14604", "Northeast", "2010-01-01"), (None, "B", "Bend", "OR", "97001", "West", "2012-01-01")])
    goods = raw(spark, "products", PRODUCTS + [(None, "Cap", "Apparel", "10.00", "V1"), (None, "Hat", "Apparel", "12.00", "V1")])
    work = Workspace(spark, {"stores": shops, "products": goods, "transactions": raw(spark, "transactions", TRANSACTIONS)}, CONFIG)
    assert work.stores.filter("store_id is null").count() == work.products.filter("product_id is null").count() == 0
    held = work.quarantine.filter("reason_code = 'NO-KEY'").groupBy("dataset").count()
    assert rows(held) == [("products", 2), ("stores", 2)]
    got = {r.dataset: r for r in work.dimension_budget.collect()}
    assert (got["stores"].source_rows, got["stores"].kept, got["stores"].quarantined) == (5, 3, 2)
    assert (got["products"].source_rows, got["products"].kept, got["products"].dropped, got["products"].quarantined) == (6, 3, 1, 2)


def test_reserved_ids_are_orphans_even_where_a_store_or_product_has_them(spark):
    """Keys of a large feed reach the ids that it plants for unknown stores and products."""
    config = RunConfig(reserved_stores=("S001",), reserved_products=("P002",))
    got = by(flagged(spark, [sale(1), sale(2, store="S003"), sale(3, store="S003", product="P002")], config=config), "transaction_id")
    assert [got[f"T{i}"].reason_code for i in (1, 2, 3)] == ["TX-04", None, "TX-05"]
    assert by(flagged(spark, [sale(1)]), "transaction_id")["T1"].disposition == "kept"
