"""Scenarios for detection rules, on tiny tables."""

import datetime as dt

import pytest

from shelfsignal.context import Context
from shelfsignal.operators import investigations, outcomes, reports, rules, state

T = dt.date(2024, 3, 31)
NOW = dt.datetime(2024, 3, 31, 12)
SALES = "tenant_id long, transaction_id string, date date, sku string, location string, store_id long, quantity double, unit_price double, total_amount double"
STOCK = "tenant_id long, id long, sku string, location string, store_id long, on_hand_qty double, reorder_point double, as_of_date date"
PRODUCTS = "tenant_id long, sku string, category string, selling_price double, unit_cost double"


def ctx(spark, sales=(), stock=(), products=(), **more):
    tables = {
        "sales": spark.createDataFrame([(1, f"t{i}", d, s, loc, 1, float(q), float(p), q * float(p)) for i, (d, s, loc, q, p) in enumerate(sales)], SALES),
        "inventory": spark.createDataFrame(list(stock), STOCK),
        "products": spark.createDataFrame(list(products), PRODUCTS),
    }
    return Context(tables | more, T, NOW, 1)


def back(n):
    return T - dt.timedelta(days=n)


def test_sales_drop_needs_impact(spark):
    rows = [(back(n), sku, "A", 100, 10) for n in range(8, 36) for sku in ("BIG", "SMALL")] + [(T, sku, "A", 1, 10) for sku in ("BIG", "SMALL")]
    found = rules.sales_drop(ctx(spark, rows, products=[(1, "BIG", "c", 100.0, 50.0), (1, "SMALL", "c", 0.01, 0.01)])).collect()
    assert [r.sku for r in found] == ["BIG"] and found[0].severity == "high"


def test_stockout_is_for_the_tenant_only(spark):
    stock = [(1, 1, "X", "A", 1, 0.0, 50.0, T), (2, 2, "Y", "A", 1, 0.0, 50.0, T), (1, 3, "Z", "A", 1, 10.0, None, T)]
    assert [r.sku for r in rules.stockout_risk(ctx(spark, stock=stock)).collect()] == ["X"]


def test_dead_stock(spark):
    stock = [(1, 1, "OLD", "A", 1, 200.0, 5.0, T), (1, 2, "NEW", "A", 1, 200.0, 5.0, T)]
    sales = [(back(91), "OLD", "A", 1, 1), (back(1), "NEW", "A", 1, 1)]
    assert [r.sku for r in rules.dead_stock(ctx(spark, sales, stock)).collect()] == ["OLD"]


def test_boundary_day_counts_in_both_windows(spark):
    got = rules.compare_sales(ctx(spark, [(back(7), "S", "A", 5, 1)]), 7).first()
    assert (got.recent_qty, got.before_qty) == (5.0, 5.0)


def test_all_rules_share_a_schema_on_empty_tables(spark):
    c = ctx(
        spark,
        returns=spark.createDataFrame([], "tenant_id long, date date, sku string, quantity double"),
        purchase_orders=spark.createDataFrame([], "tenant_id long, po_number string, supplier string, sku string, order_date date, expected_date date, received_date date, qty_ordered double, qty_received double, unit_cost double"),
        runs=spark.createDataFrame([], "tenant_id long, status string, completed_at timestamp"),
        stores=spark.createDataFrame([], "tenant_id long, id long, name string, created_at date, code string, city string, address string"),
    )
    found = rules.detect(c).collect()
    assert [r.rule_type for r in found] == ["import_frequency_gap"]  # nothing was ever imported


def test_upsert_is_idempotent(spark):
    schema = "id long, rule_type string, severity string, sku string, store_id long, investigation_id long, dismissed_at timestamp"
    old = spark.createDataFrame([(1, "r", "low", "A", None, 9, None), (2, "r", "low", "B", 1, None, None), (3, "r", "low", None, None, None, None)], schema)
    new = spark.createDataFrame([("r", "high", "A", None, 5.0, "{}"), ("r", "low", None, None, None, "{}")], "rule_type string, severity string, sku string, store_id long, revenue_impact double, context string")
    got = {(r.action, r.id, r.sku): r for r in state.upsert_anomalies(old, new).collect()}
    assert set(got) == {("update", 1, "A"), ("stale", 2, "B"), ("stale", 3, None), ("insert", None, None)}
    assert got["update", 1, "A"].severity == "high" and got["update", 1, "A"].investigation_id == 9


def test_outcome_states(spark):
    rows = [
        (1, "a", 100.0, 10.0, 95.0, 14, False), (2, "a", 100.0, 10.0, 50.0, 14, False), (3, "a", 100.0, 10.0, 10.5, 14, False), (4, "a", 0.0, 0.0, 0.0, 1, True), (5, "a", 100.0, 10.0, 95.0, 2, True),
        (6, "a", 100.0, 10.0, 95.0, 5, True), (7, "a", 100.0, 10.0, 50.0, 5, True), (8, "a", 100.0, 10.0, 10.0, 5, True), (9, "a", 0.0, 10.0, 50.0, 14, False), (10, None, 100.0, 10.0, 95.0, 14, False),
    ]
    w = spark.createDataFrame(rows, "case_id int, sku string, baseline double, during double, observed double, elapsed int, monitoring boolean")
    got = [r.outcome_state for r in outcomes.states(w).orderBy("case_id").collect()]
    assert got == ["observed_recovery", "partial_recovery", "no_material_change", "insufficient_evidence", "monitoring", "observed_recovery", "monitoring", "monitoring", "partial_recovery", "insufficient_evidence"]


def test_a_failing_rule_leaves_the_others_alone(spark):
    from shelfsignal.plans.bindings import context

    def broken(ctx):
        raise ValueError("no such column")

    seen = {}
    failed = rules.run(context(spark, "/root/testdata/sf0.001"), lambda name, rows: seen.update({name: rows.count()}), ["stockout_risk", "dead_stock"], {"broken": broken})
    assert set(seen) == {"stockout_risk", "dead_stock"} and set(failed) == {"broken"} and "no such column" in failed["broken"]


def test_rules_that_are_switched_off(spark):
    from shelfsignal.plans.bindings import context

    c = context(spark, "/root/testdata/sf0.001")
    on = rules.enabled(c)
    off = {r.rule_type for r in c.table("rule_settings").where("NOT enabled").collect()}
    assert off and set(on) == set(rules.REGISTRY) - off


def test_narration_parsing(spark):
    replies = ['```json\n{"summary": "s", "confidence": "established"}\n```', "nothing", 'x {"summary": "t", "confidence": "Probable"} y', '```JSON {"summary": "u", "confidence": "suspected"}', '{"summary": "v", "confidence": "high"}', '{"summary": "w", "confidence": "probable"}']
    rows = spark.createDataFrame([(x,) for x in replies], "reply string").coalesce(1)
    assert [(r.summary, r.confidence) for r in investigations.parse_narration(rows).collect()] == [("s", "established"), (None, "unknown"), ("t", "unknown"), ("u", "suspected"), ("v", "unknown"), ("w", "probable")]


def test_bulk_and_record_keys(spark):
    keys = spark.createDataFrame([('{"id": 5}',), ('{"data": {"id": 6}}',), ("7",)], "key string")
    assert [r.record_id for r in reports.record_key(keys).collect()] == ["5", "6", "7"]


@pytest.mark.parametrize("rule", sorted(rules.REGISTRY))
def test_registry_is_complete(rule):
    from shelfsignal.schema import RULES

    assert rule in RULES
