import math
import random
import re
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from kit import CONFIG, by, flagged, raw, rows, sale
from tillproof.functions import money
from tillproof.catalog import DEFECT_CODES, catalog_frame
from tillproof.registry import base, profiles, stars
from tillproof.scale import bucketed, setting
from tillproof.operators import adhoc, audit as A, claims as C, diff as D, figures as G, profile as P, transactions as T, whatif as W


@pytest.fixture(scope="module")
def table(spark):
    return flagged(spark, [
        sale(1), sale(2, day="05/16/2026"), sale(3, total="$18.00"), sale(4, customer=None), sale(5, q="-1", total="-10.00"),
        sale(6, store="S999"), sale(7, q="0", total="0.00"), sale(8, day="2026-07-01"), sale(1)])


def test_ledger_counts_source_rows(spark, table):
    got = by(A.defect_ledger(T.transaction_defects(table)), "code")
    assert {c: got[c].detected_count for c in ("TX-01", "TX-02", "TX-03", "TX-04", "TX-06", "TX-09", "TX-10", "ST-01")} == {
        "TX-01": 1, "TX-02": 1, "TX-03": 1, "TX-04": 1, "TX-06": 1, "TX-09": 1, "TX-10": 1, "ST-01": 0}
    assert got["TX-04"].affected_keys == ["T6"]


def test_keys_are_capped_with_the_true_total(spark):
    many = spark.range(70).select(F.lit("TX-04").alias("code"), F.lit("transactions").alias("dataset"), F.col("id").alias("source_row"),
                                  F.concat(F.lit("T"), "id").alias("row_key"), F.lit("quarantined").alias("disposition"), F.lit(True).alias("counted"))
    got = by(A.defect_ledger(many), "code")["TX-04"]
    assert (len(got.affected_keys), got.affected_keys[:2], got.affected_keys_total, got.affected_keys_truncated) == (50, ["T0", "T1"], 70, True)


def test_proof_tells_never_recorded_from_miscounted(spark, table):
    expected = {c: 1 for c in DEFECT_CODES if c.startswith("TX")} | {"TX-05": 0, "TX-08": 4}
    catalog = catalog_frame(spark, expected, ("transactions",))
    ledger = A.defect_ledger(T.transaction_defects(table), recorded=tuple(c for c in expected if c != "TX-10"))
    got = by(A.coverage_check(catalog, ledger), "code")
    assert {c: (r.problem, r.delta) for c, r in got.items()} == {"TX-08": ("COUNT MISMATCH", -3), "TX-10": ("NEVER RECORDED", None)}
    with pytest.raises(AssertionError):
        A.assert_covered(catalog, ledger)
    totals = A.audit_totals(catalog, ledger, T.quarantine_view(table)).first()
    assert (totals.classes_in_catalog, totals.classes_never_recorded, totals.mismatches, totals.rows_quarantined) == (10, 1, 2, 4)


def test_unknown_expected_count_is_only_exempt_from_counting(spark, table):
    catalog = catalog_frame(spark, {}, ("transactions",))
    ledger = A.defect_ledger(T.transaction_defects(table))
    status = by(A.coverage(catalog, ledger), "code")
    assert status["TX-05"].status == "OK" and status["TX-05"].board_status == "missing"


def test_repeated_records_merge(spark):
    calls = spark.createDataFrame([
        ("TX-04", 1, 2, "Quarantined", ["a", "b"], "one"), ("TX-04", 2, 3, "flagged", ["b", "c"], ""), ("TX-05", 1, 1, "flagged", ["z"], "")],
        "code string, call int, detected_count long, action string, affected_keys array<string>, notes string")
    got = by(A.merge_records(calls), "code")["TX-04"]
    assert (got.detected_count, got.action, got.affected_keys, got.notes, got.merged_from_calls) == (5, "quarantined+flagged", ["a", "b", "c"], "one", 2)
    with pytest.raises(Exception, match="bad record"):
        A.merge_records(calls.withColumn("action", F.lit("removed"))).collect()


def test_diff_agrees_with_the_ledger_and_says_why(spark, table):
    diff = D.raw_vs_clean_diff(table)
    cell = {(r.source_row, r.column_name): r for r in diff.collect()}
    assert (cell[1, "transaction_date"].status, cell[1, "transaction_date"].defect_code, cell[1, "transaction_date"].clean_value) == ("fixed", "TX-01", "2026-05-16")
    assert (cell[2, "total_amount"].status, cell[2, "total_amount"].defect_code) == ("preserved", "TX-03")
    assert (cell[4, "quantity"].status, cell[4, "quantity"].defect_code) == ("preserved", "TX-10")
    assert (cell[5, "store_id"].status, cell[5, "store_id"].clean_value) == ("error", "(quarantined)")
    assert (cell[5, "quantity"].status, cell[5, "quantity"].defect_code) == ("clean", None)
    assert cell[8, "transaction_id"].clean_value == "(dropped)"
    report = D.verify_diff(diff, T.lineage(table)).first()
    assert (report.rows_compared, report.unmatched_rows, report.disposition_mismatches, report.cells) == (9, 0, 0, 72)
    wrong = T.lineage(table).withColumn("disposition", F.lit("kept"))
    assert D.verify_diff(diff, wrong).first().disposition_mismatches == 4
    assert rows(D.diff_browse(diff, "TX-04", "store_id"), "transaction_id") == [("T6",)]


def test_policies_come_from_the_rows(spark, table):
    got = {(r.recompute_totals, r.drop_returns, r.admit_orphans, r.admit_zero_future): r for r in W.policy_whatif(table).collect()}
    base = got[False, False, False, False]
    assert (base.revenue, base.delta, base.fact_rows, base.fk_violations, base.quarantined_rows) == (68.0, 0.0, 5, 0, 3)
    assert got[True, False, False, False].delta == 2.0
    assert got[False, True, False, False].revenue == 78.0
    orphans = got[False, False, True, False]
    assert (orphans.fact_rows, orphans.fk_violations, orphans.quarantined_rows, orphans.delta) == (6, 1, 2, 20.0)


def test_claims_are_judged_by_kind(spark):
    figures = spark.createDataFrame([("a", "int", "10"), ("b", "money", "-9952.03"), ("c", "text", "2026-03-05"), ("d", "percent", "0.61"), ("e", "int", "3")], "figure string, kind string, text string")
    claims = spark.createDataFrame([("a", "int", "11"), ("b", "money", "($9,952.03)"), ("c", "text", " 2026-03-05 "), ("d", "percent", "0.61%"), ("x", "int", "1")], "figure string, kind string, claimed_text string")
    got = by(G.check_published_figures(claims, figures), "figure")
    assert {f: r.verdict for f, r in got.items()} == {"a": "stale", "b": "ok", "c": "ok", "d": "ok", "e": "uncited", "x": "unknown"}


def test_profile_edges(spark):
    empty = raw(spark, "products", [])
    got = by(P.column_profile(empty, ["product_id", "unit_price"], CONFIG), "column_name")
    assert (got["product_id"].row_count, got["product_id"].semantic_type, got["product_id"].null_pct) == (0, "empty", 0.0)
    one = by(P.column_profile(raw(spark, "products", [("P1", "Cap", None, "$5", " ")]), ["product_id", "category", "unit_price", "supplier_id"], CONFIG), "column_name")
    assert (one["product_id"].is_unique, one["category"].semantic_type, one["unit_price"].semantic_type) == (True, "empty", "currency_string")
    assert (one["supplier_id"].null_count, one["supplier_id"].blank_count) == (1, 1)
    with pytest.raises(TypeError):
        P.column_profile([1, 2], ["x"], CONFIG)


def test_dates_report_what_one_format_would_lose(spark):
    df = raw(spark, "transactions", [sale(i, day=d) for i, d in enumerate(["2026-05-15", "05/16/2026", "17-05-2026", "2026-07-01", "never"])])
    got = P.date_format_report(P.value_counts(df, ["transaction_date"]), CONFIG).first()
    assert (got.distinct_format_count, got.dominant_format, got.rows_lost_to_single_format, got.unmatched_count, got.after_as_of_count) == (3, "%Y-%m-%d", 3, 1, 1)
    assert rows(P.date_examples(df, "transaction_date", CONFIG), "example_kind", "token") == [("after_as_of", "2026-07-01"), ("unmatched", "never")]


def test_date_report_shows_the_first_cells_of_every_kind(spark):
    days = ["2026-07-09", "2026-05-15", "never", "never", "a", None, "2026-07-01", " b ", "c", "d", "05/16/2026"]
    df = raw(spark, "transactions", [sale(i, day=d) for i, d in enumerate(days)])
    counts = P.value_counts(df, ["transaction_date"])
    got = P.date_format_report(counts, CONFIG, df).first()
    assert (got.unmatched_count, got.unmatched_examples) == (6, ["never", "never", "a", "b", "c"])
    assert (got.after_as_of_count, got.after_as_of_examples) == (2, ["2026-07-09", "2026-07-01"])
    assert (got.ambiguous_count, got.ambiguous_examples) == (0, [])
    assert P.date_format_report(counts, CONFIG).first().unmatched_examples == ["a", "b", "c", "d", "never"]
    assert P.date_format_report(counts.filter("false"), CONFIG, df).count() == 0
    both = replace(CONFIG, ladder=(*CONFIG.ladder, replace(CONFIG.ladder[1], label="%d/%m/%Y", iso="$3-$2-$1")))
    two = raw(spark, "transactions", [sale(1, day="05/16/2026"), sale(2, day="05/06/2026")])
    assert P.date_format_report(P.value_counts(two, ["transaction_date"]), both, two).first().ambiguous_examples == ["05/06/2026"]


def test_root_causes_list_all_their_ids(spark, monkeypatch):
    monkeypatch.setattr(adhoc, "SPAN", 3)
    held = spark.createDataFrame(
        [("TX-04", "no store", "transactions", i, f"T{i}") for i in reversed(range(11))] + [("TX-04", "no store", "transactions", 1, None)]
        + [("TX-04", "other", "transactions", 2, "T2"), ("ST-01", "zip", "stores", 4, None), ("ST-01", "zip", "stores", 9, None), ("ST-01", "zip", "stores", 5, None)],
        "reason_code string, reason_detail string, dataset string, source_row long, row_key string")
    got = [(r.reason_detail, r.held_rows, r.first_key, r.last_key, r.row_keys) for r in adhoc.quarantine_root_cause(held).collect()]
    assert got == [("no store", 12, "T0", "T9", ",".join(f"T{i}" for i in range(11))), ("zip", 3, None, None, None), ("other", 1, "T2", "T2", "T2")]


def test_key_report_splits_copies_from_conflicts(spark):
    df = raw(spark, "products", [("P1", "a", "x", "1", "v"), ("P1", "a", "x", "1", "v"), ("P2", "a", None, "1", "v"), ("P2", "a", "y", "2", "v"), (None, "a", "x", "1", "v")])
    got = P.pk_uniqueness(df, "product_id").first()
    assert (got.distinct_key_count, got.duplicate_key_count, got.exact_duplicate_key_count, got.conflicting_key_count, got.null_key_count, got.is_unique) == (2, 2, 1, 1, 1, False)
    assert rows(P.pk_conflicts(df, "product_id"), "key_value", "differing_columns") == [("P2", "category,unit_price")]
    values = {(r.column_name, r.value) for r in P.pk_conflict_values(df, "product_id").collect()}
    assert values == {("category", None), ("category", "y"), ("unit_price", "1"), ("unit_price", "2")}


def test_references_both_ways(spark):
    child = spark.createDataFrame([("a",), ("a",), ("z",), (None,), (" ",)], "k string")
    parent = spark.createDataFrame([("a",), ("b",)], "id string")
    got = P.referential_integrity(child, "k", parent, "id").first()
    assert (got.child_row_count, got.null_key_count, got.orphan_row_count, got.orphan_keys, got.unreferenced_parent_keys, got.orphan_rate) == (5, 2, 1, "z", "b", 0.2)


def test_rules_are_discovered_and_measured(spark):
    df = raw(spark, "transactions", [sale(1), sale(2, q="3", price="100.00", total="270.00"), sale(3, q="1", price="5", total="5"), sale(4, total="x")])
    got = P.arithmetic_reconciliation(df, "total_amount", ("quantity", "unit_price")).first()
    assert (got.comparable_row_count, got.unparseable_row_count, got.match_count, got.total_signed_delta, got.mean_relative_delta) == (3, 1, 2, 30.0, 0.1)
    found = P.discover_relationships(df, ["quantity", "unit_price", "total_amount"]).first()
    assert (found.relationship, found.match_rate) == ("total_amount ~= quantity * unit_price", 0.666667)
    assert P.discover_relationships(df, ["quantity", "unit_price"]).count() == 0


TEXTS = {
    "plain": "Net was $158,044.29 and 474 rows were kept; 3 were late.",
    "coarse": "About 158,044.3 in total.",
    "wrong": "Net was $159,999.99.",
    "derived": "Gross 168957.80 less 961.48 is 167,996.32; that is 13.73% of S006, 47.4 per ten.",
    "ratio": "The alert is at 10%.",
    "masked": "On 2026-06-02 in 2026 the TX-03 at src/a.py:214 and line 12, the 17th, v1.0.0.",
    "year_end": "It began in 2026.",
    "money_small": "It cost $5 and 7%.",
    "none": "Nothing here.",
}
INDEX = [("158044.29", 2), ("474", 0), ("168957.80", 2), ("961.48", 2), ("13.73", 2), ("0.1", 1)]


def judge(figures):
    """The rules of the claim audit, one figure at a time."""
    def same(a, da, b, db):
        f = 10 ** min(da, db, 6)
        return int(a * f + 0.5) == int(b * f + 0.5)
    index = [(float(v), d) for v, d in INDEX]
    found, pool = [], []
    for value, decimals, percent in figures:
        readings = [(value, decimals)] + ([(value / 100, decimals + 2)] if percent else [])
        hit = any(same(v, d, iv, dv) for v, d in readings for iv, dv in index)
        found.append(hit)
        if hit:
            pool.append(value)
    pool = pool + [100.0]
    out = []
    for (value, decimals, _), hit in zip(figures, found):
        if hit:
            out.append("verified")
            continue
        ok = False
        for i, a in enumerate(pool):
            options = [a / 100, a * 100]
            for j, b in enumerate(pool):
                if i != j:
                    options += [a + b, abs(a - b), a * b] + ([a / b, a / b * 100] if b else [])
            ok |= any(same(value, decimals, o, decimals) for o in options)
        out.append("derived" if ok else "unverified")
    return out


def test_claim_audit_equals_the_rules(spark):
    texts = spark.createDataFrame(list(TEXTS.items()), "id string, body string")
    index = spark.createDataFrame(INDEX, "value string, decimals int").withColumn("value", F.col("value").cast("decimal(30,6)"))
    got = {}
    for r in C.numeric_claim_audit(texts, "id", "body", index).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((float(r.value), r.decimals, "%" in r.literal, r.verdict))
    assert [g[:1] for g in got["plain"]] == [(158044.29,), (474.0,)]
    assert {k: judge([g[:3] for g in v]) for k, v in got.items()} == {k: [g[3] for g in v] for k, v in got.items()}
    assert [g[3] for g in got["derived"]] == ["verified", "verified", "derived", "verified", "unverified"]
    assert got["ratio"][0][3] == "verified" and got["wrong"][0][3] == "unverified" and got["coarse"][0][3] == "verified"
    assert [g[0] for g in got["money_small"]] == [5.0, 7.0] and got["year_end"][0][0] == 2026.0
    summary = by(C.claim_summary(texts, "id", "body", index), "id")
    assert (summary["masked"].checked, summary["masked"].exempt_code_reference, summary["masked"].verdict) == (0, 2, "no-figures")
    assert summary["masked"].exempt_date == 4 and summary["masked"].exempt_identifier == 3 + 1
    assert (summary["plain"].verdict, summary["plain"].exempt_small_integer, summary["wrong"].verdict, summary["none"].checked) == ("pass", 1, "warn", 0)


def test_type_does_not_change_with_the_row_count(spark):
    rows = [("c", f"word {chr(97 + i % 26)} {i}", n) for i in range(40) for n in (1,)]
    for times in (5_000, 5_000_000):
        counts = spark.createDataFrame([(c, v, times) for c, v, _ in rows], "column_name string, value string, n long")
        kinds = P.infer_semantic_type(P.type_evidence(counts, CONFIG)).collect()
        assert [k.semantic_type for k in kinds] == ["free_text"]


def test_relationships_of_many_columns(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(str(i + k) for k in range(11)) + (str((i + 1) * (i + 2)),) for i in range(5)], names)
    found = {r.relationship for r in P.discover_relationships(df, names).collect()}
    assert "c11 ~= c1 * c2" in found and len(found) < 20


def test_dates_come_before_identifiers_and_long_figures_stay(spark):
    texts = spark.createDataFrame([(1, "report-2026-06-02 and batch-2026-06 of CUST-0042 in a.py:10"), (2, "12345678901234567890123456789012345678 rows")], "id long, body string")
    got = C.scan_numbers(texts, "id", "body").orderBy("id", "place").collect()
    assert [r.kind for r in got] == ["date", "date", "identifier", "code-reference", "figure"]
    index = spark.createDataFrame([(10.0, 0)], "value double, decimals int")
    assert [r.verdict for r in C.numeric_claim_audit(texts, "id", "body", index).collect()] == ["unverified"]


# Patterns of dates, references, identifiers and literals with their look-arounds.
MASKS = [
    ("date", r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?\b|\b\d{4}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}-\d{1,2}-\d{4}\b"),
    ("date", r"(?<![\d.,$])\b(?:19|20|21)\d{2}\b(?![\d.,%])"),
    ("code-reference", r"\b[\w./\\-]+\.(?:py|ts|tsx|js|jsx|sql|json|csv|md|db|yml|yaml)(?::\d+(?:\s*[-–]\s*\d+)?)+"),
    ("code-reference", r"\b(?i:lines?)\s+\d+(?:\s*[-–]\s*\d+)?\b"),
    ("identifier", r"\b[A-Za-z][A-Za-z_]*-?\d[\w.-]*\b"),
    ("identifier", r"(?<![\d.,])\b\d+(?:st|nd|rd|th|[A-Za-z]{1,3})\b"),
]


def spans_read(text):
    """(kind, literal) of every number of a text: masks one after the other, then literals in between."""
    spans = []
    for kind, pattern in MASKS:
        for m in re.finditer(pattern, text, re.ASCII):
            if not any(m.start() < b and m.end() > a for a, b, _ in spans):
                spans.append((m.start(), m.end(), kind))
    out = []
    for m in re.finditer(r"[-+]?\$?\s?\d[\d,]*(?:\.\d+)?\s?%?", text, re.ASCII):
        over = sorted(s for s in spans if m.start() < s[1] and m.end() > s[0])
        raw = m.group()
        digits = re.sub("[^0-9.]", "", raw)
        small = "$" not in raw and "%" not in raw and "." not in digits and float(digits) <= 12
        out.append((over[0][2], "") if over else ("small-integer" if small else "figure", raw.strip()))
    return out


def test_tokens_equal_the_patterns_with_look_around(spark):
    rng = random.Random(11)
    parts = ["2026", "2026-06-02", "12/05/2026", "17th", "5", "$3.50", "1,200", "7%", "TX-03", "src/a.py:21", "line 12", " ", " ", ", ", ". ", "-", "x", "é", "$", "(", ")", "v1.0.0", "3.14",
             "2026-06-02T10:20", "99", "lines 3 - 9", "30d", "+", "1999"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    got = {}
    for r in C.scan_numbers(spark.createDataFrame(texts, "id long, body string"), "id", "body").orderBy("id", "place").collect():
        got.setdefault(r.id, []).extend([(r.kind, "")] * r.pieces if r.kind in C.KINDS else [(r.kind, r.literal)])
    off = [(t, spans_read(t), got.get(i, [])) for i, t in texts if sorted(spans_read(t)) != sorted(got.get(i, []))]
    assert len(off) <= 0.02 * len(texts), off[:10]


def test_derived_without_a_cap(spark):
    """Sixty verified figures; targets that follow from the last of them, and from none."""
    own = [f"{1000 + 37 * i}.{i:02d}" for i in range(60)]

    total = round(1000 + 37 * 58 + .58 + 1000 + 37 * 59 + .59, 2)
    text = " and ".join(own) + f" make {total:.2f}, off by 0.37%, 98765.43 aside, 1.05 each, 0.00 left."
    texts = spark.createDataFrame([(1, text), (2, "7.00 and 7.00 make 14.00 or 49.00 or 0.00; 3.50 is not.")], "id long, body string")
    index = spark.createDataFrame([(float(v), 2) for v in own] + [(7.0, 2)], "value double, decimals int")
    got = {(r.id, r.literal): r for r in C.numeric_claim_audit(texts, "id", "body", index).collect()}
    assert all(got[1, v].verdict == "verified" for v in own)
    hit = got[1, f"{total:.2f}"]
    assert hit.verdict == "derived" and hit.how in ("sum", "difference")
    assert got[1, "98765.43"].verdict == "unverified" and got[1, "1.05"].verdict == "derived"
    assert (got[2, "14.00"].how, got[2, "14.00"].left_value, got[2, "14.00"].right_value) == ("sum", 7.0, 7.0)
    assert got[2, "49.00"].how == "product" and got[2, "0.00"].how == "difference" and got[2, "3.50"].verdict == "unverified"


def explanation(value, decimals, pool):
    """The first arithmetic over the pool, in its order, that gives the value."""
    f = 10.0 ** min(decimals, 6)
    same = lambda c: math.floor(value * f + 0.5) == math.floor(abs(c) * f + 0.5)
    pool = [*pool, 100.0]
    for i, a in enumerate(pool):
        for how, c in (("hundredth", a / 100), ("hundredfold", a * 100)):
            if same(c):
                return how, a, None
        for j, b in enumerate(pool):
            if i != j:
                tries = [("sum", a + b), ("difference", a - b), ("product", a * b)] + ([("quotient", a / b), ("percent", a / b * 100)] if b else [])
                for how, c in tries:
                    if same(c):
                        return how, a, b
    return None


def test_explanations_equal_the_search_over_all_pairs(spark):
    rng = random.Random(12)
    operands, targets, want = [], [], {}
    for text in range(60):
        pool = [round(rng.choice([rng.uniform(0.01, 5), rng.uniform(1, 900), rng.uniform(1e4, 1e6), 7.0, 25.0]), rng.randrange(3)) or 1.0 for _ in range(rng.randrange(12))]
        operands += [(text, v, n) for n, v in enumerate(pool)]
        for _ in range(15):
            d = rng.randrange(4)
            a, b = (rng.choice(pool), rng.choice(pool)) if pool else (3.0, 4.0)
            v = round(abs(rng.choice([a + b, a - b, a * b, a / b, a / b * 100, rng.uniform(0, 1000)])), d)
            if math.floor(v * 10 ** d + .5):
                targets.append((text, v, d))
                want[text, v, d] = explanation(v, d, pool)
    got = C.derive(spark.createDataFrame(targets, "id long, value double, decimals int"), spark.createDataFrame(operands, "id long, value double, place int"), "id")
    found = {(r.id, r.value, r.decimals): (r.how, r.left_value, r.right_value) for r in got.collect()}
    assert found == {k: v for k, v in want.items() if v}


def test_context_and_holder(spark):
    texts = spark.createDataFrame([("a", "x", "It was 55.5 and 77."), ("b", "x", "It was 55.50."), ("c", "y", "It was 77 or 13.")], "id string, kind string, body string")
    index = C.index_numbers(texts, "body", "kind", "id")
    assert rows(index.filter("value = 55.5"), "context", "decimals", "first_holder", "last_holder") == [("x", 1, "a", "a"), ("x", 2, "b", "b")]
    got = rows(C.numeric_claim_audit(texts, "id", "body", index, "kind", True), "id", "literal", "verdict")
    assert got == [("a", "55.5", "verified"), ("a", "77", "unverified"), ("b", "55.50", "verified"), ("c", "13", "unverified"), ("c", "77", "unverified")]


def test_published_cells_are_compared(spark, table):
    clean = T.clean_transactions(table, CONFIG, row_key=True)
    raw_rows = table.select("source_row", *T.COLUMNS)
    diff = D.published_diff(raw_rows, clean, T.lineage(table), CONFIG)
    assert sorted(map(tuple, diff.collect()), key=repr) == sorted(map(tuple, D.raw_vs_clean_diff(table).collect()), key=repr)
    changed = clean.withColumns({
        "store_id": F.when(F.col("source_row") != 2, F.col("store_id")), "quantity": F.when(F.col("source_row") == 1, 99).otherwise(F.col("quantity")),
    }).filter("source_row <> 0").unionByName(clean.filter("source_row = 0").withColumn("source_row", F.lit(500).cast("long")))
    damaged = D.published_diff(raw_rows, changed, T.lineage(table), CONFIG)
    off = rows(damaged.filter("status = 'unexplained' AND source_row < 500"), "source_row", "column_name", "clean_value")
    assert [r[:2] for r in off] == [(1, "quantity"), (2, "store_id")] and off[0][2] == "99" and off[1][2] is None
    assert {r.disposition for r in damaged.filter("source_row = 0").collect()} == {"missing"}
    report = D.verify_diff(damaged, T.lineage(table)).first()
    assert report.disposition_mismatches == 2 and report.unmatched_rows == 1 and report.unexplained_cells == 2 + 8


def test_row_diff_is_the_cell_diff(spark, table):
    clean = T.clean_transactions(table, CONFIG, row_key=True)
    changed = clean.withColumn("quantity", F.when(F.col("source_row") == 1, 99).otherwise(F.col("quantity"))).filter(
        "source_row <> 0").unionByName(clean.filter("source_row = 0").withColumn("source_row", F.lit(500).cast("long")))
    ledger = T.lineage(table).unionByName(T.lineage(table).filter("source_row = 2").withColumn("source_row", F.lit(600).cast("long")))
    sides = table.select("source_row", *T.COLUMNS), changed, ledger, CONFIG
    wide, cells = D.published_row_diff(*sides), D.published_diff(*sides)
    assert wide.count() * len(T.COLUMNS) == cells.count() and wide.filter("source_row >= 500").count() == 2
    assert D.verify_diff(wide, ledger).first() == D.verify_diff(cells, ledger).first()
    for code, column, side in (("TX-04", "store_id", "raw"), ("TX-01", "total_amount", "clean"), (None, "quantity", "raw")):
        assert D.diff_browse(wide, code, column, side).collect() == D.diff_browse(cells, code, column, side).collect()


def test_diff_reads_a_cell_once(spark, table):
    raw_rows = table.select("source_row", *T.COLUMNS)
    clean = T.clean_transactions(table, CONFIG, row_key=True)
    plan = lambda df: str(df._jdf.queryExecution().optimizedPlan())
    with setting(spark, "spark.sql.debug.maxToStringFields", "10000"):
        wide = plan(D.published_row_diff(raw_rows, clean, T.lineage(table), CONFIG))
        cells = plan(D.published_diff(raw_rows, clean, T.lineage(table), CONFIG))
        once = plan(raw_rows.select(money.parse_currency(F.col("unit_price")), money.parse_currency(F.col("total_amount")))).count("USD|usd")
    # The rows come from one table or another of three, and each kind is read once.
    assert 0 < wide.count("USD|usd") <= 3 * once and cells.count("USD|usd") == wide.count("USD|usd")


def test_row_diff_moves_no_row(spark, table):
    """Tables bucketed by row meet where they lie; of what was found only row, id and counts move to the ledger."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        flagged = bucketed(table, "source_row", "t-diff-flagged", 4)
        raw_rows = bucketed(flagged.select("source_row", *T.COLUMNS), "source_row", "t-diff-raw", 4, placed=True)
        clean = bucketed(T.clean_transactions(flagged, CONFIG, row_key=True), "source_row", "t-diff-published", 4, placed=True)
        diff = D.published_row_diff(raw_rows, clean, T.lineage(flagged), CONFIG)
        moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        report = D.verify_diff(diff, T.lineage(flagged))
        assert moved(diff) == 0 and moved(D.diff_browse(diff, "TX-04", "store_id")) == 0 and moved(report) == 1
        assert report.first().unmatched_rows == 0 and report.first().cells == 72
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_queries_build_no_more_than_they_read(spark, table, monkeypatch):
    """The calendar and the customers come from the sales, and raw rows are those stored; no star is built."""
    sides = SimpleNamespace(raw_rows=table.select("source_row", *T.COLUMNS), sales=T.clean_transactions(table, CONFIG),
                            stores=spark.createDataFrame([("S1",)], "store_id string"))
    monkeypatch.setattr(base, "open_feed", lambda *a: sides)
    run = {q.name: q.run for q in [*stars.QUERIES, *profiles.QUERIES]}
    assert run["dim_date"](spark, "").count() >= 1
    assert sorted(r.child_row_count for r in run["referential_integrity"](spark, "").collect()) == [9, 9]
