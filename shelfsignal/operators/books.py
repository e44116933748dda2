"""Reports of a period: the sections of their summary and the registers behind them, as frames for a workbook or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import rule_label, words
from ..schema import RULE_LABELS
from .health import snapshots, warnings
from .reports import _within

# What the outcomes that are named otherwise than by the words of their key are called, and the datasets in their order.
OUTCOME_TYPES = {"resolved": "Resolved", "false_positive": "False Positive", "duplicate": "Duplicate", "escalated_to_ops": "Escalated to Ops", "no_action_needed": "No Action Needed"}
METHODS = {"sales_rebound": "Sales Rebound", "stockout_cleared": "Stockout Cleared", "return_rate_drop": "Return Rate Drop", "manual_estimate": "Manual Estimate"}


def _first_up(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def _called(c: Column, names: dict[str, str]) -> Column:
    """The name of a key; an unknown key with its first letter as a capital."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, c), _first_up(c))


def _minute(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _money(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _rule(c: Column) -> Column:
    """What a rule is called; the words of an unknown one's key."""
    return F.when(c.isin(*RULE_LABELS), rule_label(c)).otherwise(words(c))


def _outcomes(ctx: Context, first, last) -> DataFrame:
    return ctx.table("outcomes").where(_within("recorded_at", first, last))


def recovery_sections(ctx: Context, first, last) -> DataFrame:
    """Recovery of the outcomes recorded in a period by cause (the latest anomaly's rule), store and action (the latest completed one's type): section, key, recovered, at_risk, outcomes, most outcomes first.

    Each outcome counts in one row of each section: the three keys are joined
    first, so that outcomes are read once.
    """
    o = _outcomes(ctx, first, last)
    ids = o.select("investigation_id").distinct()
    cause = ctx.table("anomalies").join(ids, "investigation_id", "left_semi").groupBy("investigation_id").agg(F.max_by("rule_type", F.struct("detected_at", "id")).alias("cause"))
    action = ctx.table("actions").where("status = 'completed'").join(ids, "investigation_id", "left_semi").groupBy("investigation_id").agg(F.max_by("action_type", F.struct("completed_at", "id")).alias("action"))
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "primary_store_id")
    s = ctx.table("stores").select(F.col("id").alias("primary_store_id"), F.col("name").alias("store"))
    rows = o.join(cause, "investigation_id", "left").join(action, "investigation_id", "left").join(i, "investigation_id", "left").join(s, "primary_store_id", "left")
    keys = {"Recovery by cause": F.coalesce(_rule(F.col("cause")), F.lit("Uncategorised")), "Recovery by store": F.coalesce("store", F.lit("Unassigned")), "Recovery by action": words(F.coalesce("action", F.lit("no_action")))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("section"), v.alias("key")) for k, v in keys.items())))
    rows = rows.select(each.alias("x"), "revenue_recovered", "revenue_at_risk").groupBy("x.section", "x.key")
    rows = rows.agg(F.round(F.sum(_money("revenue_recovered")), 2).alias("recovered"), F.round(F.sum(_money("revenue_at_risk")), 2).alias("at_risk"), F.count("*").alias("outcomes"))
    return rows.orderBy("section", F.desc("outcomes"), "key")


def outcome_register(ctx: Context, first, last) -> DataFrame:
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "title", "primary_sku")
    rows = _outcomes(ctx, first, last).join(i, "investigation_id", "left")
    return rows.select(
        F.col("investigation_id").alias("Investigation"), _text("title").alias("Title"), _text("primary_sku").alias("SKU"), _called(F.col("outcome_type"), OUTCOME_TYPES).alias("Outcome"), words(F.col("outcome_state")).alias("State"),
        _money("revenue_at_risk").alias("Revenue at Risk"), _money("revenue_recovered").alias("Observed Recovery"), _money("action_cost").alias("Cost to Resolve"), F.coalesce(_called(F.col("recovery_method"), METHODS), F.lit("—")).alias("Recovery Method"), _minute("recorded_at").alias("Recorded"),
    )


def _counts(rows: DataFrame, **sections: tuple[Column, Column]) -> DataFrame:
    """Counts by some keys in one pass: section, key, n, most frequent first; ``sections``: key and how it is shown."""
    each = F.explode(F.array(*(F.struct(F.lit(name.replace("_", " ").capitalize()).alias("section"), shown(F.coalesce(F.col(key), F.lit("unknown"))).alias("key")) for name, (key, shown) in sections.items())))
    return rows.select(each.alias("x")).groupBy("x.section", "x.key").agg(F.count("*").alias("n")).orderBy("section", F.desc("n"), "key")


def investigation_sections(ctx: Context, first, last) -> DataFrame:
    """Investigations opened in a period by status and by priority."""
    return _counts(ctx.table("investigations").where(_within("opened_at", first, last)), by_status=("status", words), by_priority=("priority", _first_up))


def investigation_register(ctx: Context, first, last) -> DataFrame:
    """Investigations opened in a period, the newest first."""
    s = ctx.table("stores").select(F.col("id").alias("primary_store_id"), F.col("name").alias("store"))
    t = ctx.table("teams").select(F.col("id").alias("assigned_team_id"), F.col("name").alias("team"))
    o = ctx.table("outcomes").select(F.col("investigation_id").alias("id"), "revenue_recovered")
    rows = ctx.table("investigations").where(_within("opened_at", first, last)).join(s, "primary_store_id", "left").join(t, "assigned_team_id", "left").join(o, "id", "left")
    return rows.orderBy(F.desc("opened_at"), "id").select(
        F.col("id").alias("ID"), F.col("title").alias("Title"), _text("primary_sku").alias("SKU"), _text("store").alias("Store"), words(F.col("status")).alias("Status"), _first_up(F.col("priority")).alias("Priority"), _text("team").alias("Team"),
        F.coalesce("anomaly_count", F.lit(0)).cast("long").alias("Anomalies"), _money("revenue_at_risk").alias("Revenue at Risk"), _money("revenue_recovered").alias("Observed Recovery"), _minute("opened_at").alias("Opened"), _minute("resolved_at").alias("Resolved"),
    )


def anomaly_sections(ctx: Context, first, last) -> DataFrame:
    """Anomalies detected in a period by rule, with those dismissed and false, most detections first; and by severity."""
    rows = ctx.table("anomalies").where(_within("detected_at", first, last))
    keys = [F.struct(F.lit("By rule").alias("section"), _rule(F.col("rule_type")).alias("key")), F.struct(F.lit("By severity").alias("section"), _first_up(F.coalesce("severity", F.lit("unknown"))).alias("key"))]
    rows = rows.select(F.explode(F.array(*keys)).alias("x"), "dismissed_at", "is_false_positive").groupBy("x.section", "x.key")
    rows = rows.agg(F.count("*").alias("detections"), F.count("dismissed_at").alias("dismissed"), F.count_if("is_false_positive").alias("false_positives"))
    return rows.orderBy("section", F.desc("detections"), F.desc("dismissed"), F.desc("false_positives"), "key")


def anomaly_register(ctx: Context, first, last) -> DataFrame:
    """Anomalies detected in a period, the newest first."""
    s = ctx.table("stores").select(F.col("id").alias("store_id"), F.col("name").alias("store"))
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    rows = ctx.table("anomalies").where(_within("detected_at", first, last)).join(s, "store_id", "left")
    return rows.orderBy(F.desc("detected_at"), "id").select(
        F.col("id").alias("ID"), rule_label(F.col("rule_type")).alias("Rule"), _first_up(F.col("severity")).alias("Severity"), _text("sku").alias("SKU"), _text("store").alias("Store"), _minute("detected_at").alias("Detected"),
        _text(F.col("investigation_id").cast("string")).alias("Investigation"), yes(F.col("dismissed_at").isNotNull()).alias("Dismissed"), yes(F.coalesce("is_false_positive", F.lit(False))).alias("False Positive"),
    )


def health_sections(ctx: Context) -> DataFrame:
    """The state of each dataset now, as a summary shows it."""
    whole = lambda c: F.coalesce(F.format_number(F.col(c).cast("double"), 0), F.lit("—"))
    with_ = lambda c, unit: F.coalesce(F.concat(F.col(c).cast("string"), F.lit(unit)), F.lit("—"))
    return snapshots(ctx).select(
        words(F.col("dataset")).alias("Dataset"), _first_up(F.replace("status", F.lit("_"), F.lit(" "))).alias("Status"), whole("score").alias("Score"), with_("hours", " h").alias("Freshness"), with_("completeness", "%").alias("Completeness"), with_("validity", "%").alias("Validity"),
        F.concat_ws(" / ", whole("received"), whole("accepted"), whole("rejected")).alias("Rec / Acc / Rej"),
    )


def health_register(ctx: Context) -> DataFrame:
    return snapshots(ctx).select(
        words(F.col("dataset")).alias("Dataset"), F.col("status").alias("Status"), F.col("score").alias("Score"), F.col("hours").alias("Freshness (h)"), F.col("completeness").alias("Completeness %"), F.col("validity").alias("Validity %"), F.col("received").alias("Received"),
        F.col("accepted").alias("Accepted"), F.col("rejected").alias("Rejected"), _minute("newest").alias("Last Record"),
    )


def warning_register(ctx: Context) -> DataFrame:
    return warnings(ctx).select(words(F.col("dataset")).alias("Dataset"), _first_up(F.col("level")).alias("Level"), F.col("message").alias("Message"))


def book(ctx: Context, kind: str, first, last) -> dict[str, DataFrame]:
    """All frames of a report (recovery, investigations, anomalies, data_health): the summary's figures, sections, and registers."""
    from . import reports

    if kind == "recovery":
        return {"Summary": reports.recovery_report(ctx, first, last), "Response times": reports.period_times(ctx, first, last), "Recovery": recovery_sections(ctx, first, last), "Outcomes": outcome_register(ctx, first, last)}
    if kind == "investigations":
        return {"Summary": reports.investigation_report(ctx, first, last), "Sections": investigation_sections(ctx, first, last), "Investigations": investigation_register(ctx, first, last)}
    if kind == "anomalies":
        return {"Summary": reports.anomaly_report(ctx, first, last), "Sections": anomaly_sections(ctx, first, last), "Anomalies": anomaly_register(ctx, first, last)}
    if kind == "data_health":
        return {"Summary": reports.health_report(ctx, first, last), "Datasets": health_sections(ctx), "Dataset Health": health_register(ctx), "Warnings": warning_register(ctx)}
    raise ValueError(f"no report is called {kind}")
