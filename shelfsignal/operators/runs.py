"""Runs over committed state: each reads one version of the tables and publishes the next one, whole.

A run that is killed changes nothing, and one that is repeated gives the rows
of one: detections overwrite what they find again, correlation takes only what
belongs to no investigation, ledgers take a signature once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import priority_name, priority_rank, severity_rank
from ..sources.store import Store
from . import investigations, outcomes, watches
from .state import last_per_key, same_keys

KEYS = ["rule_type", "sku", "store_id"]


def with_ids(rows: DataFrame, keys: list[str], last: DataFrame, id_: str = "id") -> DataFrame:
    """``rows`` with ids that follow the one in ``last`` (one row), in the order of the md5 of ``keys``.

    The first two digits deal the rows over 256 groups, each numbered on its
    own; what comes before a group is a sum over 256 counts.
    """
    text = F.to_json(F.struct(*(F.col(k) for k in keys)))
    rows = rows.withColumn("_md5", F.md5(text)).withColumn("_group", F.substring("_md5", 1, 2))
    before = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    before = before.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"))  # 256 rows
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_group").orderBy("_md5"))).join(F.broadcast(before), "_group").crossJoin(F.broadcast(last.toDF("_last")))  # one row
    return rows.withColumn(id_, (F.col("_last") + F.col("_before") + F.col("_k")).cast("long")).drop("_md5", "_group", "_before", "_k", "_last")


def _last_id(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)))


def merged_anomalies(old: DataFrame, detections: DataFrame, now: Column, rules: Iterable[str] | None = None) -> DataFrame:
    """All anomalies after the detections of ``rules`` (all where none are named: those that ran without an error).

    An open row that is found again takes severity, impact and context; its
    number, first detection and investigation stay. What is not found again
    goes; new rows are numbered on. Detections without a SKU are always new.
    Dismissed rows and those of other rules stay.
    """
    ran = F.lit(True) if rules is None else F.col("rule_type").isin(*rules)
    live = old.where(F.col("dismissed_at").isNull() & ran)
    rest = old.where(F.col("dismissed_at").isNotNull() | ~ran)
    found = detections.where(ran).select(*KEYS, "severity", "revenue_impact", "context")
    keyed = last_per_key(found.where("sku IS NOT NULL"), KEYS, F.desc_nulls_last("revenue_impact"), F.desc("context"))
    both = keyed.alias("n").join(last_per_key(live.where("sku IS NOT NULL"), KEYS, "id").alias("o"), same_keys(KEYS), "left")
    types = {f.name: f.dataType for f in old.schema.fields}
    fresh = {c: F.col(f"n.{c}").cast(types[c]) for c in (*KEYS, "severity", "revenue_impact", "context")}
    again = both.where("o.id IS NOT NULL").select(*(fresh.get(c, F.col(f"o.{c}")).alias(c) for c in old.columns))
    added = both.where("o.id IS NULL").select(*(F.col(f"n.{c}") for c in found.columns)).unionByName(found.where("sku IS NULL"))
    added = with_ids(added.withColumn("detected_at", now), [*KEYS, "severity", "revenue_impact", "context"], _last_id(old))
    tenant = old.agg(F.max("tenant_id").alias("tenant_id")) if "tenant_id" in old.columns else None
    added = added if tenant is None else added.crossJoin(F.broadcast(tenant))  # one row
    added = added.select(*(F.col(c).cast(types[c]).alias(c) for c in added.columns))
    return rest.unionByName(again.select(*old.columns)).unionByName(added, allowMissingColumns=True)


def correlated(ctx: Context) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anomalies, investigations and entities after correlation.

    Candidates that nothing suppresses go to the newest open investigation of
    their SKU, or all of a SKU's to a new one, named after the first of them.
    Investigations that got a member are counted and weighed anew.
    """
    a, i = ctx.table("anomalies"), ctx.table("investigations")
    groups = investigations.correlation_groups(ctx)
    opened = groups.where("investigation_id IS NULL").select("sku", F.col("new_title").alias("title"), "team_id", "first_store_id")
    opened = with_ids(opened, ["sku", "title"], _last_id(i))
    new = opened.select(
        "id", F.lit(ctx.tenant_id).cast("long").alias("tenant_id"), "title", F.lit("open").alias("status"), F.lit("low").alias("priority"), F.col("sku").alias("primary_sku"), F.col("first_store_id").alias("primary_store_id"), ctx.clock().alias("opened_at"),
        F.col("team_id").alias("assigned_team_id"), F.when(F.col("team_id").isNotNull(), ctx.clock()).alias("assigned_at"), F.lit(0).cast("long").alias("anomaly_count"),
    )
    types = {f.name: f.dataType for f in i.schema.fields}
    new = new.select(*(F.col(c).cast(types[c]).alias(c) for c in new.columns if c in types))
    everyone = i.unionByName(new, allowMissingColumns=True)
    target = groups.where("investigation_id IS NOT NULL").select("sku", "investigation_id").unionByName(opened.select("sku", F.col("id").alias("investigation_id")))
    waiting = investigations.candidates(ctx).join(investigations.suppression_matches(ctx), F.col("id") == F.col("anomaly_id"), "left_anti")
    links = waiting.alias("w").join(target.alias("t"), F.col("w.sku").eqNullSafe(F.col("t.sku"))).select(F.col("w.id").alias("id"), F.col("t.investigation_id").alias("_to"))
    members = a.join(links, "id", "left").withColumn("investigation_id", F.coalesce("investigation_id", "_to"))
    touched = links.select(F.col("_to").alias("investigation_id")).distinct()
    sums = members.join(touched, "investigation_id", "left_semi").groupBy(F.col("investigation_id").alias("id")).agg(
        F.count("*").alias("_n"), F.round(F.coalesce(F.sum("revenue_impact"), F.lit(0)), 2).alias("_risk"), F.max(severity_rank(F.col("severity"))).alias("_worst")
    )
    rows, hit = everyone.join(sums, "id", "left"), F.col("_n").isNotNull()
    rows = rows.withColumns(
        {
            "anomaly_count": F.coalesce("_n", "anomaly_count").cast(types["anomaly_count"]), "revenue_at_risk": F.when(hit, F.col("_risk")).otherwise(F.col("revenue_at_risk")).cast(types["revenue_at_risk"]),
            "priority": F.when(hit, priority_name(F.greatest(priority_rank(F.col("priority")), F.col("_worst")))).otherwise(F.col("priority")),
        }
    ).select(*i.columns)
    members = members.select(*a.columns)
    entities = investigations.entities(Context({**ctx.tables, "anomalies": members}, ctx.as_of, ctx.now, ctx.tenant_id, ctx.thresholds))
    return members, rows, entities


def _at(ctx: Context, **tables: DataFrame) -> Context:
    return Context({**ctx.tables, **tables}, ctx.as_of, ctx.now, ctx.tenant_id, ctx.thresholds)


def load(store: Store, **tables: DataFrame) -> int:
    """The first version of some tables, or the next one with them replaced."""
    with store.begin() as t:
        for name, df in tables.items():
            t.write(name, df)
    return store.version()


def detection_run(store: Store, ctx: Context, detections: DataFrame, rules: Iterable[str] | None = None) -> int:
    """Detections merged into the anomalies, these correlated, suppressions counted: one version."""
    with store.begin() as t:
        anomalies = t.write("anomalies", merged_anomalies(t.read("anomalies"), detections, ctx.clock(), rules))
        now = _at(ctx, anomalies=anomalies, investigations=t.read("investigations"), suppressions=t.read("suppressions"))
        members, rows, entities = correlated(now)
        counted = investigations.suppressions_counted(now)
        t.write("suppressions", counted)
        t.write("investigations", rows)
        t.write("entities", entities)
        t.write("anomalies", members)
    return store.version()


def measurement_run(store: Store, ctx: Context, sales: str = "sales") -> int:
    """Measurements appended and outcomes brought up to date: one version."""
    with store.begin() as t:
        measured = outcomes.measurements(ctx, sales)
        if "measurements" in t.tables:
            done = t.read("measurements").select("case_id", "measured_at")
            measured = measured.withColumn("measured_at", ctx.clock()).join(done, ["case_id", "measured_at"], "left_anti")  # a repeated run adds none
        else:
            measured = measured.withColumn("measured_at", ctx.clock())
        t.append("measurements", measured)
        t.write("outcomes", outcomes.upserted(t.read("outcomes"), outcomes.measurements(ctx, sales), ctx.clock()))
    return store.version()


def watch_run(store: Store, ctx: Context) -> DataFrame:
    """Watches evaluated and what they tell put into their ledger, as one version; returns the rows that users are told of."""
    with store.begin() as t:
        now = _at(ctx, watches=t.read("watches"), watch_ledger=t.read("watch_ledger"))
        told = t.write("told", watches.notifications(now))
        t.append("watch_ledger", told.select("watch_id", "signature", ctx.clock().alias("sent_at")))
        after = watches.evaluated(now)
        columns = now.table("watches").columns
        ended = now.table("watches").where("NOT active")
        t.write("watches", after.select(*(c for c in after.columns if c in columns or c == "ended_at")).unionByName(ended, allowMissingColumns=True))
    return watches.recipients(ctx, store.read("told"))
