"""Scenarios of single tenants, step by step: health, outcomes, quality, watches, imports, mail."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from shelfsignal.context import Context
from shelfsignal.operators import health, metrics, outcomes, reports, watches
from shelfsignal.sources import files, imports, mail

T = dt.date(2024, 6, 1)
NOW = dt.datetime(2024, 6, 1, 12)


def table(spark, schema, rows=()):
    return spark.createDataFrame(list(rows), schema)


def health_tables(spark, sales=(), **more):
    tables = {
        "sales": table(spark, "tenant_id long, sku string, quantity double, total_amount double, date date", sales),
        "products": table(spark, "tenant_id long, sku string, name string, unit_cost double, selling_price double, updated_at timestamp", [(1, "A", "a", 1.0, 2.0, NOW)]),
        "inventory": table(spark, "tenant_id long, sku string, on_hand_qty double, as_of_date date"),
        "purchase_orders": table(spark, "tenant_id long, sku string, qty_ordered double, order_date date"),
        "stores": table(spark, "tenant_id long, name string, updated_at timestamp", [(1, "s", NOW)]),
        "suppliers": table(spark, "tenant_id long, name string, updated_at timestamp", [(1, None, None)]),
        "runs": table(spark, "tenant_id long, id long, data_type string, rows_processed long, rows_imported long, rows_failed long, validation_score double, started_at timestamp, completed_at timestamp"),
    }
    return Context(tables | more, T, NOW, 1)


def test_health_counts_orphans_and_empty_tables(spark):
    rows = [(1, "A", 1.0, 2.0, T)] * 5 + [(1, "GHOST", 1.0, 2.0, T), (2, "B", 1.0, 2.0, T)]
    got = {r.dataset: r for r in health.snapshots(health_tables(spark, rows)).collect()}
    sales = got["sales"]
    assert (sales.received, sales.hours, sales.completeness, sales.validity) == (6, 0, 100.0, 100.0) and sales.score is not None
    assert [(w.level, w.message) for w in sales.warnings] == [("critical", "1 sales record(s) reference a SKU with no matching product.")] and sales.status == "critical"
    assert got["inventory"].status == "no_data" and got["inventory"].score is None and got["inventory"].warnings[0].message == "No inventory data has been ingested yet."
    assert got["products"].status == "healthy" and got["suppliers"].completeness == 0.0 and got["suppliers"].status == "critical"
    total = health.overall(health_tables(spark, rows)).first()
    assert total.status == "critical" and total.datasets == 6


@pytest.mark.parametrize(("hours", "level"), [(48, None), (49, "warning"), (96, "warning"), (97, "critical")])
def test_old_data_is_critical_beyond_twice_the_limit(spark, hours, level):
    c = health_tables(spark, [(1, "A", 1.0, 2.0, T)])
    c.tables["sales"] = c.tables["sales"].withColumn("date", F.lit(dt.datetime.combine(T, dt.time()) - dt.timedelta(hours=hours)))
    sales = health.snapshots(c).where("dataset = 'sales'").first()
    assert [w.level for w in sales.warnings] == ([level] if level else [])


def test_own_limits_and_rejections(spark):
    settings = table(spark, "tenant_id long, dataset string, freshness_max_hours int, completeness_min_pct double, rejection_max_pct double", [(1, "sales", 10, None, 60.0), (2, "sales", 1, 1.0, 1.0)])
    runs = table(spark, "tenant_id long, id long, data_type string, rows_processed long, rows_imported long, rows_failed long, validation_score double, started_at timestamp, completed_at timestamp", [(1, 1, "sales", 9, 9, 0, None, NOW, NOW), (1, 2, "sales", 10, 9, 1, None, NOW, None)])
    rows = [(1, "A", 1.0, None, T), (1, "A", 1.0, 2.0, T)]
    sales = health.snapshots(health_tables(spark, rows, health_settings=settings, runs=runs)).where("dataset = 'sales'").first()
    assert (sales.completeness, sales.validity, sales.accepted, sales.rejected) == (87.5, 90.0, 9, 1)
    assert [w.message for w in sales.warnings] == ["Sales completeness 87.5% is below the 90% target."]
    sales = health.snapshots(health_tables(spark, rows, runs=runs)).where("dataset = 'sales'").first()
    assert sales.warnings[1].message == "Rejection rate 50% exceeds the 5% threshold (possible rejection spike)."


def sold(spark, level):
    days = [(T - dt.timedelta(days=n), float(level(n))) for n in range(5, 66)]
    return table(spark, "tenant_id long, sku string, date date, quantity double, unit_price double, total_amount double", [(1, "A", d, v, 1.0, v) for d, v in days if v])


@pytest.mark.parametrize(("level", "states"), [(lambda n: 10 if 20 < n < 38 else 100, {"observed_recovery"}), (lambda n: 100 if n >= 38 else 10, {"no_material_change", "insufficient_evidence"})])
def test_outcome_of_a_completed_action(spark, level, states):
    cases = table(spark, "case_id long, sku string, detected_on date, done_on date", [(1, "A", T - dt.timedelta(days=30), T - dt.timedelta(days=20))])
    c = Context({"sales": sold(spark, level), "cases": cases}, T, NOW, 1)
    got = outcomes.measurements(c).first()
    assert got.outcome_state in states and not got.monitoring and got.elapsed == 14


def test_an_entered_recovery_stays(spark):
    old = table(spark, "investigation_id long, outcome_state string, observed_recovery double, attribution_status string, evidence_strength string, next_measurement_at timestamp_ntz", [(1, "monitoring", 5.0, "x", "y", None), (2, "monitoring", None, "x", "y", None), (3, "z", None, "x", "y", None)])
    new = table(spark, "case_id long, outcome_state string, recovery_amount double, monitoring boolean", [(1, "observed_recovery", 9.0, False), (2, "partial_recovery", 9.0, False), (4, "monitoring", 9.0, True)])
    got = {r.investigation_id: (r.outcome_state, r.observed_recovery, r.attribution_status, r.next_measurement_at) for r in outcomes.upserted(old, new, F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert got == {1: ("observed_recovery", 5.0, "estimated", None), 2: ("partial_recovery", 9.0, "not_attempted", None), 3: ("z", None, "x", None), 4: ("monitoring", None, "not_attempted", NOW + dt.timedelta(days=1))}


def test_quality_is_withheld_with_few_resolved(spark):
    tables = {
        "anomalies": table(spark, "tenant_id long, id long, is_false_positive boolean, dismissed_at timestamp", [(1, 1, True, NOW), (1, 2, False, None), (2, 3, True, NOW)]),
        "investigations": table(spark, "tenant_id long, id long, status string, snoozed_until timestamp, narrated_at timestamp, ai_confidence string", [(1, 1, "resolved", None, None, None)]),
        "actions": table(spark, "tenant_id long, investigation_id long, status string"),
        "suppressions": table(spark, "tenant_id long, active boolean, starts_at timestamp, expires_at timestamp, match_count long"),
    }
    c = Context(tables, T, NOW, 1)
    rates = metrics.rates(c).first()
    assert (rates.false_positive, rates.acceptance, rates.dismissal, rates.action_completion, rates.suppressed_matches) == (50.0, 50.0, 0.0, None, 0)
    assert tuple(metrics.quality_score(c).first()) == (1, False, None)


def test_anomalies_count_by_store_with_and_without_a_row(spark):
    ago = lambda days: NOW - dt.timedelta(days=days)
    rows = [(1, 3, ago(1)), (1, 3, ago(30)), (1, 3, ago(31)), (1, 4, ago(2)), (1, 9, ago(2)), (1, None, ago(1)), (2, 3, ago(1))]
    stores = table(spark, "tenant_id long, id long, name string", [(1, 3, "North"), (1, 4, "North"), (1, 5, "South"), (2, 9, "Other")])
    c = Context({"anomalies": table(spark, "tenant_id long, store_id long, detected_at timestamp", rows), "stores": stores}, T, NOW, 1)
    got = {(r.name, r.store, r.anomalies) for r in reports.anomalies_by_store(c).collect()}
    assert got == {("Store 3", "North", 2), ("Store 4", "North", 1), ("Store 9", None, 1)}


def watch_context(spark, status, ledger=()):
    schema = "tenant_id long, id long, investigation_id long, user_id long, team_id long, mode string, until_date timestamp, active boolean, triggers array<string>, last_status string, last_priority string, last_actions long, last_completed long, last_overdue long, last_escalations long, last_at_risk double, last_recovered double"
    tables = {
        "watches": table(spark, schema, [(1, 7, 1, 5, None, "until_resolved", None, True, None, "open", "low", 0, 0, 0, 0, 0.0, 0.0), (1, 8, 1, None, 2, "indefinite", None, True, ["overdue"], "open", "low", 0, 0, 0, 0, 0.0, 0.0)]),
        "investigations": table(spark, "tenant_id long, id long, title string, status string, priority string, revenue_at_risk double", [(1, 1, "t", status, "low", None)]),
        "actions": table(spark, "tenant_id long, investigation_id long, status string, due_at timestamp"),
        "escalation_events": table(spark, "tenant_id long, investigation_id long"),
        "outcomes": table(spark, "tenant_id long, investigation_id long, revenue_recovered double"),
        "watch_ledger": table(spark, "watch_id long, signature string, sent_at timestamp", ledger),
        "team_members": table(spark, "tenant_id long, team_id long, user_id long", [(1, 2, 5), (1, 2, 6)]),
    }
    return Context(tables, T, NOW, 1)


def test_a_watch_tells_once_and_ends(spark):
    c = watch_context(spark, "resolved")
    sent = watches.notifications(c).collect()
    assert {(r.watch_id, r.signature) for r in sent} == {(7, "status_change:open->resolved"), (7, "resolution:resolved")}
    again = watch_context(spark, "resolved", [(r.watch_id, r.signature, NOW) for r in sent])
    assert watches.notifications(again).count() == 0
    assert {r.id: (r.active, r.last_status) for r in watches.evaluated(c).collect()} == {7: (False, "resolved"), 8: (True, "resolved")}
    assert [tuple(r) for r in watches.expiry(c).collect()] == [(7, "resolved")]
    both = c.table("watches").withColumn("signature", F.lit("s")).select("team_id", "user_id", F.col("id").alias("watch_id"), "signature")
    assert sorted((r.watch_id, r.recipient_id) for r in watches.recipients(c, both).collect()) == [(7, 5), (8, 5), (8, 6)]
    assert watches.of_user(c, 6).count() == 1 and watches.of_user(c, 5).count() == 2


def test_rejected_rows_are_retried(spark):
    rows = table(spark, "import_id long, _order long, date string, sku string, quantity string", [(1, 1, "2024-01-01", "A", "2"), (1, 2, "2024-01-01", "B", ""), (2, 1, "2024-01-01", "C", "1")])
    good, bad = imports.retried(rows, "returns")
    assert sorted((r.import_id, r._order) for r in good.collect()) == [(1, 1), (2, 1)] and [(r.import_id, r.error) for r in bad.collect()] == [(1, "Missing required field: quantity")]
    ledger = table(spark, "id long, status string, imported_rows long, failed_rows long", [(1, "completed_with_errors", 5, 2), (2, "completed_with_errors", 3, 1), (3, "failed", 0, 4)])
    assert sorted(map(tuple, imports.after_retry(ledger, good, bad).select("id", "status", "imported_rows", "failed_rows").collect())) == [(1, "completed_with_errors", 6, 1), (2, "completed", 4, 0), (3, "failed", 0, 4)]
    untried = table(spark, "import_id long, sku string", [(1, "D"), (2, "E"), (2, "F"), (3, "G")])  # what nobody retried still counts
    assert sorted(map(tuple, imports.after_retry(ledger, good, bad, untried).select("id", "status", "imported_rows", "failed_rows").collect())) == [(1, "completed_with_errors", 6, 2), (2, "completed_with_errors", 4, 2), (3, "failed", 0, 4)]


def test_rows_without_a_key_are_all_kept(spark):
    old = table(spark, "transaction_id string, q int", [("a", 1), (None, 2), ("b", 3)])
    new = table(spark, "transaction_id string, q int, _order int", [(None, 4, 1), (None, 5, 2), ("", 6, 3), ("", 7, 4), ("0", 8, 5), ("a", 9, 6), ("a", 10, 7), (None, 5, 8)])
    got = sorted(map(tuple, imports.upsert(old, new, ["transaction_id"]).collect()), key=repr)
    assert got == sorted([("a", 10), ("b", 3), (None, 2), (None, 4), (None, 5), (None, 5), ("", 6), ("", 7), ("0", 8)], key=repr)


def test_new_members_are_numbered_without_gaps(spark):
    names = table(spark, "location string", [(f"n{i % 40}",) for i in range(100)] + [(" n1 ",), ("",), (None,)])
    found, everyone = imports.resolve_dimension(names, table(spark, "id long, name string", [(7, "n3"), (9, "n5")]), "location")
    assert sorted(r.id for r in everyone.collect()) == [7, 9, *range(10, 48)] and found.count() == 103
    assert found.where("location_id IS NULL").count() == 2


def test_replies_by_mail(spark):
    rows = [
        ("m1", "Ann <ANN@x.org>", "d@x.org; reply+7-abc@in.org", "", " hello \r\nworld\r\n> old\nmore"), ("m1", "ann@x.org", "reply+7-abc@in.org", "", "hello again"), ("m2", "ann@x.org", "inbox@in.org", "Re: [INV-7-abc] x", "one\nOn Monday Bob wrote:\ntwo"),
        ("m3", "ann@x.org", "inbox@in.org", "x", "y"), ("m4", "ann@x.org", "reply+7-bad@in.org", "", "y"), ("m5", "eve@y.org", "reply+7-abc@in.org", "", "y"), ("m6", "nobody", "reply+7-abc@in.org", "", "y"), ("m7", "ann@x.org", "reply+7-abc@in.org", "", "From: a@b.c\nz"),
        ("m8", "ann@x.org", "reply+7-abc@in.org", "", "seen"), (None, "ann@x.org", "reply+7-abc@in.org", "", "no id"), (None, "ann@x.org", "reply+7-abc@in.org", "", None),
    ]
    inbox = table(spark, "message_id string, sender string, recipient string, subject string, body string", rows)
    signature = hmac.new(b"k", b"7", hashlib.sha256).hexdigest()[:16]
    inbox = inbox.withColumns({c: F.replace(c, F.lit("7-abc"), F.lit(f"7-{signature}")) for c in ("recipient", "subject")})
    cases, users = table(spark, "id long, tenant_id long", [(7, 1)]), table(spark, "id long, tenant_id long, email string", [(5, 1, "Ann@x.org"), (9, 1, "ANN@x.org"), (6, 2, "eve@y.org")])
    new, ignored = mail.comments(inbox, cases, users, table(spark, "investigation_id long, message_id string", [(7, "m8"), (8, "m2")]), b"k")
    assert {r.author_id for r in new.collect()} == {5}
    got = {r.message_id: r.body for r in new.collect()}
    assert new.count() == 3 and got["m1"] in ("hello \nworld", "hello again") and got["m2"] == "one" and got[None] == "no id"
    assert {r.message_id: r.reason for r in ignored.collect()} == {"m3": "no reply token found", "m4": "invalid token", "m5": "sender is not a user of this tenant", "m6": "no sender address", "m7": "empty message body", "m8": "already posted", None: "empty message body"}
    none, ignored = mail.comments(inbox, cases.where("id = 0"), users, table(spark, "investigation_id long, message_id string"), b"k")
    assert none.count() == 0 and "investigation not found" in {r.reason for r in ignored.collect()}


@pytest.mark.parametrize("key", [b"k", b"", b"x" * 64, bytes(range(256)), b"inbound"])
def test_tokens_are_signed(spark, key):
    n = 1000
    rows = {r.id: r for r in spark.range(n).select("id", mail.signed(F.col("id"), key).alias("token")).collect()}
    assert all(r.token == f"{i}-{hmac.new(key, str(i).encode(), hashlib.sha256).hexdigest()[:16]}" for i, r in rows.items())
    made = table(spark, "id long, token string", [(i, r.token) for i, r in rows.items()])
    assert made.where(mail.resolved(F.col("token"), key) == F.col("id")).count() == n
    forged = ["7-", "7", "-abc", "x-1", "", None, rows[7].token + "0", rows[7].token[:-1], "0" + rows[7].token, rows[7].token.upper() + "A", f"8-{rows[7].token[2:]}", rows[7].token.replace("7-", "7--", 1)]
    assert table(spark, "token string", [(t,) for t in forged]).where(mail.resolved(F.col("token"), key).isNotNull()).count() == 0


def test_a_sheet_holds_all_rows_or_none(spark):
    df = spark.range(30).toDF("n")
    assert len(list(files.sheet_rows(files.report({"All": df})))) == 31
    with pytest.raises(ValueError, match="more than 20 rows"):
        files.report({"All": df}, 20)


def test_order_of_rows_over_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("﻿SKU , Qty\n" + "".join(f"k,{i}{j}\n" for j in range(5)) + ",\n")
    rows = files.read_csv(spark, str(tmp_path)).repartition(4)
    assert rows.columns == ["SKU", "Qty", "_order"] and rows.count() == 15
    assert imports.upsert(table(spark, "SKU string, Qty string"), rows, ["SKU"]).collect()[0].Qty == "24"


def test_polled_files(spark):
    feeds = table(spark, "id long, connection_id long, remote_path string, pattern string, data_type string, enabled boolean", [(1, 1, " in/ ", "sales_*.csv", "sales", True), (2, 1, "in", "", "inventory", True), (3, 1, None, "a?.csv", "sales", True), (4, 2, "in", "*", "sales", True), (5, 1, "in", "*", "sales", False)])
    connections = table(spark, "id long, tenant_id long, active boolean", [(1, 9, True), (2, 9, False)])
    there = table(spark, "connection_id long, path string", [(1, "in/Sales_1.CSV"), (1, "in/old.csv"), (1, "in/x.csv"), (1, "ab.csv"), (1, "abc.csv"), (1, "out/sales_1.csv"), (2, "in/y.csv"), (1, "in/a+b.csv")])
    due = files.due_files(there, connections, feeds, table(spark, "connection_id long, path string, status string", [(1, "in/old.csv", "failed")]))
    assert {(r.path, r.feed_id, r.data_type) for r in due.collect()} == {("in/Sales_1.CSV", 1, "sales"), ("in/x.csv", 2, "inventory"), ("in/a+b.csv", 2, "inventory"), ("ab.csv", 3, "sales")}
    taken = due.select("connection_id", "feed_id", "path", "filename", F.when(F.col("path") == "ab.csv", 0).otherwise(5).alias("size"), F.lit(8).alias("import_id"), F.when(F.col("path") == "in/x.csv", "boom").alias("error"))
    ledger = files.poll_ledger(table(spark, "connection_id long, path string, status string", [(1, "in/old.csv", "failed")]), taken, F.lit(NOW))
    assert {r.path: (r.status, r.error, r.import_id) for r in ledger.where("processed_at IS NOT NULL").collect()} == {"in/Sales_1.CSV": ("imported", None, 8), "in/x.csv": ("failed", "boom", None), "in/a+b.csv": ("imported", None, 8), "ab.csv": ("failed", "Empty or unreadable remote file.", None)}
    assert files.due_files(there, connections, feeds, ledger).count() == 0
