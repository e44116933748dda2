"""Committed state: versions, killed runs, parts, and runs over them."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from shelfsignal.context import Context
from shelfsignal.operators import runs
from shelfsignal.sources.store import Conflict, Store

NOW = dt.datetime(2024, 1, 31)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_kept(spark, store):
    one, two = spark.range(3), spark.range(5)
    assert store.version() == 0
    assert runs.load(store, a=one, b=one) == 1
    old = store.read("a")
    with store.begin() as t:
        assert t.write("a", two).count() == 5 and t.read("b").count() == 3
        assert store.read("a").count() == 3
    assert store.version() == 2 and store.versions() == [1, 2]
    assert store.read("a").count() == 5 and store.read("b").count() == 3
    assert store.read("a", 1).count() == 3 and old.count() == 3
    runs.load(store, e=spark.range(0))
    assert store.read("e").count() == 0 and store.read("e").columns == ["id"]


def test_a_failed_run_leaves_no_trace(spark, store):
    runs.load(store, a=spark.range(3))
    folders = store._names("data/a")
    with pytest.raises(ZeroDivisionError), store.begin() as t:
        t.write("a", spark.range(9))
        1 / 0
    assert store.version() == 1 and store.read("a").count() == 3 and store._names("data/a") == folders
    killed = store.begin()  # never ends: its files stay until they are old
    killed.write("a", spark.range(7))
    assert store.read("a").count() == 3 and len(store._names("data/a")) == 2
    assert store.vacuum() == [] and len(store.vacuum(hours=0)) == 1
    assert store._names("data/a") == folders and store.read("a").count() == 3


def test_the_second_of_two_runs_is_told(spark, store):
    runs.load(store, a=spark.range(1))
    first, second = store.begin(), store.begin()
    first.write("a", spark.range(2))
    second.write("a", spark.range(4))
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert store.read("a").count() == 2 and len(store._names("data/a")) == 2


def test_parts_leave_other_files_alone(spark, store, tmp_path):
    fact = lambda i, n: spark.range(n).select(F.lit(i).cast("long").alias("import_id"), F.col("id").cast("string").alias("sku"))
    with store.begin() as t:
        t.append("facts", fact(1, 4).union(fact(2, 3)).union(fact(None, 2)), by="import_id")
    with store.begin() as t:
        t.append("facts", fact(2, 5).union(fact(3, 1)), by="import_id")
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    before = files()
    count = lambda v=None: {r["import_id"]: r["count"] for r in store.read("facts", v).groupBy("import_id").count().collect()}
    assert count() == {1: 4, 2: 8, 3: 1, None: 2}
    with store.begin() as t:  # an import undone
        assert t.drop("facts", [2, 77]) == ["2"]
    assert count() == {1: 4, 3: 1, None: 2} and files() == before
    with store.begin() as t:  # another one read anew
        t.replace("facts", fact(1, 6), by="import_id")
    assert count() == {1: 6, 3: 1, None: 2} and count(2) == {1: 4, 2: 8, 3: 1, None: 2}
    assert {k: v for k, v in files().items() if k in before} == before
    assert store.read("facts", parts=[3, None]).count() == 3 and store.read("facts", parts=[9]).count() == 0
    with pytest.raises(ValueError, match="kept by"), store.begin() as t:
        t.append("facts", fact(1, 1))


A = "tenant_id long, id long, rule_type string, severity string, sku string, store_id long, revenue_impact decimal(18,2), context string, detected_at timestamp_ntz, dismissed_at timestamp_ntz, investigation_id long"
I = "tenant_id long, id long, title string, status string, priority string, primary_sku string, primary_store_id long, revenue_at_risk decimal(18,2), anomaly_count long, opened_at timestamp_ntz, assigned_team_id long, assigned_at timestamp_ntz"  # noqa: E741
S = "id long, scope_type string, rule_type string, store_id long, sku string, starts_at timestamp_ntz, expires_at timestamp_ntz, active boolean, match_count long"
D = "rule_type string, severity string, sku string, store_id long, revenue_impact double, context string"


def with_money(spark, schema, rows):
    """Whole numbers as decimals where the schema has these."""
    return spark.createDataFrame(rows, schema.replace("decimal(18,2)", "long")).selectExpr(*(f"cast({n} as {t}) as {n}" for n, t in (f.rsplit(" ", 1) for f in schema.split(", "))))


def begin(spark, store):
    long_ago, day = dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 30)
    runs.load(
        store,
        anomalies=with_money(spark, A,
            [
                (1, 1, "sales_drop", "low", "A", 1, 10, "old", long_ago, None, 5), (1, 2, "sales_drop", "low", "B", 1, 20, "old", long_ago, None, None), (1, 3, "sales_drop", "high", "A", 1, 5, "gone", long_ago, long_ago, 5),
                (1, 4, "po_overdue", "low", "C", None, 7, "other rule", long_ago, None, None), (1, 5, "sales_drop", "low", None, 2, 3, "no sku", long_ago, None, None),
            ],
        ),
        investigations=with_money(spark, I, [(1, 5, "Five", "open", "low", "A", 1, 15, 2, long_ago, None, None), (1, 6, "Six", "open", "critical", "D", 1, 0, 0, day, None, None)]),
        suppressions=spark.createDataFrame([(1, "rule_sku", "sales_drop", None, "E", long_ago, None, True, 3)], S),
    )
    stores, teams = spark.createDataFrame([(1, "North"), (2, "South")], "id long, name string"), spark.createDataFrame([(9, True)], "id long, is_default boolean")
    detections = [("sales_drop", "high", "A", 1, 100.0, "new"), ("sales_drop", "medium", "D", 1, 50.0, "new"), ("sales_drop", "high", "E", 1, 1.0, "new"), ("sales_drop", "low", None, 2, 4.0, "no sku"), ("sales_drop", "low", "D", 1, 60.0, "more"), ("store_outlier", "low", "F", 2, 2.5, "x")]
    return Context({"stores": stores, "teams": teams, "entities": stores}, NOW.date(), NOW, 1, {}), spark.createDataFrame(detections, D)


def test_runs_of_detection(spark, store):
    ctx, detections = begin(spark, store)
    broken = detections.withColumn("severity", F.when(F.col("sku") == "A", F.raise_error(F.lit("killed"))).otherwise(F.col("severity")))
    ran = ["sales_drop", "store_outlier"]
    with pytest.raises(Exception, match="killed"):
        runs.detection_run(store, ctx, broken, ran)
    assert store.version() == 1
    assert runs.detection_run(store, ctx, detections, ran) == 2
    facts = lambda: rows(store.read("anomalies").select("rule_type", "sku", "severity", "revenue_impact", "context", "dismissed_at", F.when(F.col("id") <= 5, F.col("id")).alias("old_id")))
    once = facts()
    assert {(r[1], r[4]): r[6] for r in once} == {("A", "new"): 1, ("A", "gone"): 3, ("C", "other rule"): 4, ("D", "more"): None, ("E", "new"): None, ("F", "x"): None, (None, "no sku"): None}
    cases = lambda: rows(store.read("investigations").select("id", "title", "primary_sku", "priority", "anomaly_count", "revenue_at_risk", "assigned_team_id"))
    assert {r[1:] for r in cases()} == {
        ("Five", "A", "low", 2, 15, None), ("Six", "D", "critical", 1, 60, None), ("Store Outlier \u2014 SKU F \u2014 @ South", "F", "low", 1, 2.5, 9), ("Sales Drop \u2014 @ South", None, "low", 1, 4, 9), ("PO Overdue \u2014 SKU C", "C", "low", 1, 7, 9),
    }
    links = {r["sku"]: r["investigation_id"] for r in store.read("anomalies").where("dismissed_at IS NULL").collect()}
    number = {r["primary_sku"]: r["id"] for r in store.read("investigations").collect()}
    assert links == {"A": 5, "C": number["C"], "D": 6, "E": None, "F": number["F"], None: number[None]}
    assert rows(store.read("suppressions").select("match_count")) == [(4,)]
    ids = [r["id"] for r in store.read("anomalies").collect()]
    assert len(ids) == len(set(ids)) and {r["entity_key"] for r in store.read("entities").collect()} >= {"A", "D", "F"}
    before = cases()
    assert runs.detection_run(store, ctx, detections, ran) == 3
    assert facts() == once and cases() == before
    assert rows(store.read("investigations", 2)) == rows(store.read("investigations", 3))


def test_runs_of_measurement(spark, store):
    day = dt.date(2024, 1, 1)
    sales = spark.createDataFrame([("A", day + dt.timedelta(i), 100.0 if i < 20 or i > 30 else 10.0, 1.0, 1.0) for i in range(-40, 46)], "sku string, date date, total_amount double, quantity double, unit_price double")
    cases = spark.createDataFrame([(7, "A", day + dt.timedelta(20), day + dt.timedelta(30))], "case_id long, sku string, detected_on date, done_on date")
    first = spark.createDataFrame([(7, "monitoring", 12.5, "not_attempted", "insufficient", None)], "investigation_id long, outcome_state string, observed_recovery double, attribution_status string, evidence_strength string, next_measurement_at timestamp_ntz")
    runs.load(store, outcomes=first)
    c = Context({"sales": sales, "cases": cases}, dt.date(2024, 3, 1), NOW, 1)
    assert runs.measurement_run(store, c) == 2
    once = rows(store.read("measurements")), rows(store.read("outcomes"))
    assert len(once[0]) == 1 and store.read("outcomes").first()["observed_recovery"] == 12.5
    assert runs.measurement_run(store, c) == 3  # at the same time: nothing is measured twice
    assert (rows(store.read("measurements")), rows(store.read("outcomes"))) == once
    assert runs.measurement_run(store, Context(c.tables, c.as_of, NOW + dt.timedelta(days=1), 1)) == 4 and store.read("measurements").count() == 2


def test_runs_of_watches(spark, store):
    from test_scenarios import watch_context

    c = watch_context(spark, "resolved")
    runs.load(store, watches=c.table("watches"), watch_ledger=spark.createDataFrame([], "watch_id long, signature string, sent_at timestamp_ntz"))
    told = runs.watch_run(store, c)
    assert told.count() > 0 and store.version() == 2
    sent = rows(store.read("watch_ledger").select("watch_id", "signature"))
    assert sent and store.read("watches").count() == c.table("watches").count()
    assert runs.watch_run(store, c).count() == 0 and rows(store.read("watch_ledger").select("watch_id", "signature")) == sent


def test_entry_of_a_workbook(spark, tmp_path):
    from shelfsignal.sources import files

    (tmp_path / "a.xlsx").write_bytes(files.workbook({"One": (["SKU ", "", "Qty"], [("A", None, 1), (None, None, None), ("B", "x", 2.5)])}))
    got = files.read_workbook(spark, f"file://{tmp_path}/a.xlsx")
    assert got.columns == ["SKU", "column_1", "Qty", "_order"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("A", "", "1"), ("B", "x", "2.5")]
