"""Detection quality and recovery metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import hours_between, priority_rank

def pct(a: Column, b: Column) -> Column:
    """Percentage to one digit; null without a denominator."""
    return F.when(b > 0, F.round(a.cast("double") / b.cast("double") * 100 + 1e-9, 1))


# The stages of the funnel, in order, and the outcome states that count as recovery.
STAGES = ("Potential anomalies", "Investigations", "Reviewed / accepted", "Actionable", "Action taken", "Resolved", "Observed recovery")
RECOVERED = ("observed_recovery", "partial_recovery")


def _investigated(ctx: Context) -> DataFrame:
    """Investigations with whether they have an action, and a completed one."""
    a = ctx.table("actions").groupBy(F.col("investigation_id").alias("id")).agg(F.bool_or(F.col("status") == "completed").alias("done"))
    return ctx.table("investigations").join(a, "id", "left")


def funnel(ctx: Context) -> DataFrame:
    """Seven stages from detection to observed recovery."""
    status = F.col("status")
    i = _investigated(ctx).agg(
        F.count("*").alias("s1"), F.count_if(status.isin("in_progress", "resolved", "closed")).alias("s2"), F.count("done").alias("s3"), F.count_if("done").alias("s4"), F.count_if(status.isin("resolved", "closed")).alias("s5")
    )
    row = ctx.table("anomalies").agg(F.count("*").alias("s0")).crossJoin(i).crossJoin(ctx.table("outcomes").agg(F.count_if(F.col("outcome_state").isin(*RECOVERED)).alias("s6")))  # rows of one
    pairs = ", ".join(f"'{name}', s{k}" for k, name in enumerate(STAGES))
    return row.selectExpr(f"stack({len(STAGES)}, {pairs}) AS (stage, n)")


def rates(ctx: Context) -> DataFrame:
    """Shares of anomalies, investigations and actions, and the counts they are shares of."""
    from .investigations import active_suppressions

    c = F.col
    a = ctx.table("anomalies").agg(F.count("*").alias("anomalies"), F.count_if("is_false_positive").alias("fp"), F.count("dismissed_at").alias("dismissed"))
    i = ctx.table("investigations").agg(
        F.count("*").alias("investigations"), F.count_if(c("snoozed_until").cast("timestamp_ntz") > ctx.clock()).alias("snoozed"), F.count_if(c("status").isin("resolved", "closed")).alias("resolved"),
        F.count("narrated_at").alias("narrated"), F.count_if(c("ai_confidence") == "established").alias("established"),
    )
    x = ctx.table("actions").agg(F.count("*").alias("actions"), F.count_if(c("status") == "completed").alias("done"))
    s = active_suppressions(ctx).agg(F.count("*").alias("active_suppressions")).crossJoin(ctx.table("suppressions").agg(F.coalesce(F.sum("match_count"), F.lit(0)).alias("suppressed_matches")))
    row = a.crossJoin(i).crossJoin(x).crossJoin(s)  # rows of one
    return row.select(
        pct(c("anomalies") - c("dismissed"), c("anomalies")).alias("acceptance"), pct(c("fp"), c("anomalies")).alias("false_positive"), pct(F.greatest(F.lit(0), c("dismissed") - c("fp")), c("anomalies")).alias("dismissal"),
        pct(c("snoozed"), c("investigations")).alias("snooze"), "active_suppressions", "suppressed_matches", pct(c("established"), c("narrated")).alias("established_cause"), pct(c("done"), c("actions")).alias("action_completion"),
        pct(c("resolved"), c("investigations")).alias("resolution"), "anomalies", "investigations", "actions", "resolved",
    )


def evidence_strength(ctx: Context) -> DataFrame:
    """How much of the evidence of the tenant's investigations is strong, moderate and insufficient (weak)."""
    rows = ctx.table("evidence").join(ctx.table("investigations").select(F.col("id").alias("investigation_id")), "investigation_id", "left_semi")
    return rows.agg(F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "moderate").alias("moderate"), F.count_if(F.col("strength") == "weak").alias("insufficient"))


def evidence_label(ctx: Context) -> DataFrame:
    """Of the supporting pieces: strong with three strong ones, or one of three and more; moderate with one strong or two."""
    supporting = F.col("direction") == "supports"
    strong, supports = F.count_if(supporting & (F.col("strength") == "strong")), F.count_if(supporting)
    rows = ctx.table("evidence").groupBy("investigation_id").agg(strong.alias("strong"), supports.alias("supports"))
    label = F.when((F.col("strong") >= 3) | ((F.col("strong") >= 1) & (F.col("supports") >= 3)), "Strong").when((F.col("strong") >= 1) | (F.col("supports") >= 2), "Moderate").otherwise("Insufficient")
    return rows.withColumn("label", label)


def action_quality(ctx: Context) -> DataFrame:
    """Actions completed, cancelled, in progress and not started, and outcomes that show a recovery."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    row = ctx.table("actions").agg(n("completed").alias("completed"), n("cancelled").alias("cancelled"), n("in_progress").alias("in_progress"), n("unassigned", "assigned", "acknowledged").alias("open"))
    return row.crossJoin(ctx.table("outcomes").agg(F.count_if(F.col("outcome_state").isin(*RECOVERED)).alias("completed_with_recovery")))


def rule_performance(ctx: Context) -> DataFrame:
    rows = ctx.table("anomalies").groupBy("rule_type").agg(
        F.count("*").alias("detections"), F.count_if(F.col("dismissed_at").isNotNull()).alias("dismissed"), F.count_if("is_false_positive").alias("false_positives"), F.count_distinct("investigation_id").alias("investigations")
    )
    return rows.withColumn("fp_rate", pct(F.col("false_positives"), F.col("detections")))


def noisy_rules(ctx: Context, detections: int = 5, rate: float = 30) -> DataFrame:
    return rule_performance(ctx).where((F.col("detections") >= detections) & (F.col("fp_rate") >= rate)).select("rule_type", "detections", "fp_rate")


def noisy_skus(ctx: Context, limit: int = 10) -> DataFrame:
    return ctx.table("anomalies").where("sku IS NOT NULL").groupBy("sku").agg(F.count("*").alias("anomalies"), F.count_if("is_false_positive").alias("false_positives")).orderBy(F.desc("anomalies"), "sku").limit(limit)


def quality_score(ctx: Context, least: int = 20) -> DataFrame:
    """Mean of acceptance, 100 less false positives, resolution and completion; withheld with under ``least`` resolved."""
    row, zero = rates(ctx), F.lit(0.0)
    mean = (F.coalesce("acceptance", zero) + 100 - F.coalesce("false_positive", zero) + F.coalesce("resolution", zero) + F.coalesce("action_completion", zero)) / 4
    return row.select(F.col("resolved").alias("sample_size"), (F.col("resolved") >= least).alias("available"), F.when(F.col("resolved") >= least, F.round(mean + 1e-9, 1)).alias("quality_score"))


def recovery_summary(ctx: Context) -> DataFrame:
    """Totals of all outcomes, and investigations resolved to date; no rate without anything at risk."""
    zero = F.lit(0)
    row = ctx.table("outcomes").agg(F.coalesce(F.sum("revenue_at_risk"), zero).alias("at_risk"), F.coalesce(F.sum("revenue_recovered"), zero).alias("recovered"), F.count("*").alias("outcomes"), F.count_if("was_false_positive").alias("false_positives"))
    done = ctx.table("investigations").agg(F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved"))
    return row.crossJoin(done).withColumn("recovery_rate", pct(F.col("recovered"), F.col("at_risk")))


def _by(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("outcomes"), F.coalesce(F.sum("revenue_at_risk"), F.lit(0)).alias("at_risk"), F.coalesce(F.sum("revenue_recovered"), F.lit(0)).alias("recovered"))


def recovery_by_cause(ctx: Context) -> DataFrame:
    """By the rule of the investigation's latest anomaly."""
    last = ctx.table("anomalies").where("investigation_id IS NOT NULL").groupBy("investigation_id").agg(F.max_by("rule_type", F.struct("detected_at", "id")).alias("cause"))
    return _by(ctx.table("outcomes").join(last, "investigation_id", "left").withColumn("cause", F.coalesce("cause", F.lit("uncategorised"))), "cause")


def recovery_by_action(ctx: Context) -> DataFrame:
    last = ctx.table("actions").where("status = 'completed'").groupBy("investigation_id").agg(F.coalesce(F.max_by("action_type", F.struct("completed_at", "id")), F.lit("other")).alias("action_type"))
    return _by(ctx.table("outcomes").join(last, "investigation_id", "left").withColumn("action_type", F.coalesce("action_type", F.lit("no_action"))), "action_type")


def recovery_by_store(ctx: Context) -> DataFrame:
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "primary_store_id")
    s = ctx.table("stores").select(F.col("id").alias("primary_store_id"), "name")
    return _by(ctx.table("outcomes").join(i, "investigation_id").join(s, "primary_store_id", "left").withColumn("store", F.coalesce("name", F.lit("Unassigned"))), "store")


def response_times(ctx: Context) -> DataFrame:
    """Average hours to the first action and to resolution; negative ones don't count."""
    first = ctx.table("actions").groupBy("investigation_id").agg(F.min("created_at").alias("first_action"))
    rows = ctx.table("investigations").join(first, F.col("id") == F.col("investigation_id"), "left")
    act, res = hours_between(F.col("first_action"), F.col("opened_at")), hours_between(F.col("resolved_at"), F.col("opened_at"))
    return rows.agg(F.round(F.avg(F.when(act >= 0, act)), 1).alias("hours_to_action"), F.round(F.avg(F.when(res >= 0, res)), 1).alias("hours_to_resolution"))


def primary_anomaly(ctx: Context) -> DataFrame:
    """Each investigation's worst anomaly, the first of equals, with the hours its priority allows; the number names the year it was opened."""
    from ..functions.columns import severity_rank

    w = Window.partitionBy("investigation_id").orderBy(F.desc(F.coalesce(severity_rank(F.col("severity")), F.lit(1))), "id")
    a = ctx.table("anomalies").where("investigation_id IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    i = ctx.table("investigations").select(F.col("id").alias("i_id"), "priority", F.coalesce(F.year("opened_at"), F.lit(ctx.now.year)).alias("opened_year"))
    rank = priority_rank(F.col("priority"))
    hours = F.when(rank == 4, 2).when(rank == 3, 4).when(rank == 2, 8).otherwise(24)
    return a.join(i, F.col("investigation_id") == F.col("i_id")).select(F.format_string("INV-%d-%06d", F.col("opened_year"), F.col("investigation_id")).alias("display_id"), "rule_type", "severity", F.col("id").alias("anomaly_id"), hours.cast("long").alias("sla_hours"))
