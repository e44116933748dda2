"""What came of an investigation: revenue before, during and after, the state it shows, and the record of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..functions.ranges import interval_join, pruned

# Days of monitoring after an action, days before anything is concluded, the share of the baseline that
# counts as recovered and the uplift over the low that counts in part, and the states after which nothing is measured again.
MONITORING, LEAST_DAYS, RECOVERED, UPLIFT = 14, 3, 0.90, 0.10
TERMINAL = ("observed_recovery", "no_material_change")


def _round(c: Column, digits: int) -> Column:
    return F.round(c + F.lit(1e-9), digits)


def candidates(ctx: Context) -> DataFrame:
    """Investigations to measure: under way or over, with a completed action (the latest counts), and not concluded for good."""
    done = ctx.table("actions").where("status = 'completed' AND completed_at IS NOT NULL").groupBy("investigation_id").agg(F.max_by(F.struct("id", "completed_at"), F.struct("completed_at", "id")).alias("a"))
    seen = ctx.table("anomalies").where("investigation_id IS NOT NULL").groupBy("investigation_id").agg(F.min("detected_at").alias("first_detected"))
    known = ctx.table("outcomes").where(F.col("outcome_state").isin(*TERMINAL) & F.col("next_measurement_at").isNull()).select("investigation_id")
    i = ctx.table("investigations").where(F.col("status").isin("in_progress", "resolved", "closed")).withColumnRenamed("id", "investigation_id")
    rows = i.join(known, "investigation_id", "left_anti").join(done, "investigation_id").join(seen, "investigation_id", "left")
    return rows.select("investigation_id", F.col("primary_sku").alias("sku"), F.col("a.id").alias("action_id"), F.coalesce("first_detected", "opened_at", "a.completed_at").cast("date").alias("detected_on"), F.col("a.completed_at").cast("date").alias("done_on"))


def windows(ctx: Context, sales: str = "sales") -> DataFrame:
    """Daily revenue before, during and after, for ``cases``: case_id, sku, the day of detection and of the latest completed action."""
    cases = ctx.table("cases").withColumns({"w_from": F.date_sub("detected_on", 35), "w_to": F.date_add("done_on", MONITORING)})
    det, done, end = F.col("detected_on"), F.col("done_on"), F.least(ctx.day(), F.col("w_to"))
    amount = F.coalesce(F.col("total_amount").cast("double"), F.col("quantity").cast("double") * F.coalesce("unit_price", F.lit(0.0)))
    daily = pruned(ctx.table(sales), cases, "w_from", "w_to", "date").groupBy("sku", "date").agg(F.sum(amount).alias("amount"))
    near = interval_join(cases.select("case_id", "sku", "detected_on", "done_on", "w_from", "w_to"), daily, "sku", "w_from", "w_to", "date")
    within = lambda a, z: F.sum(F.when(F.col("date").between(a, z), F.col("amount")))
    spans = {"baseline": (F.date_sub(det, 35), F.date_sub(det, 8)), "during": (F.date_sub(det, 7), done), "observed": (done, end)}
    sums = near.groupBy("case_id").agg(*(within(a, z).alias(f"s_{name}") for name, (a, z) in spans.items()))
    per = lambda name, a, z: F.when(F.datediff(z, a) > 0, F.coalesce(f"s_{name}", F.lit(0.0)) / F.datediff(z, a)).otherwise(F.lit(0.0))
    return cases.join(sums, "case_id", "left").select(
        "case_id", "sku", "detected_on", "done_on", *(_round(per(name, a, z), 4).alias(name) for name, (a, z) in spans.items()),
        F.greatest(F.lit(1), F.datediff(end, done)).cast("long").alias("elapsed"), (F.col("w_to") > ctx.day()).alias("monitoring"),
    )


def states(rows: DataFrame) -> DataFrame:
    """The state that the three daily revenues give; order matters. Nothing but a recovery is concluded while monitoring lasts."""
    b, d, o, on = F.col("baseline"), F.col("during"), F.col("observed"), F.col("monitoring")
    state = F.when(F.col("sku").isNull() | ((b <= 0) & (o <= 0)), "insufficient_evidence").when((F.col("elapsed") < LEAST_DAYS) & on, "monitoring")
    state = state.when((b > 0) & (o >= RECOVERED * b), "observed_recovery").when(on, "monitoring")
    return rows.withColumn("outcome_state", state.when((d >= 0) & (o > (1 + UPLIFT) * d) & (o > d), "partial_recovery").otherwise("no_material_change"))


def measurements(ctx: Context, sales: str = "sales") -> DataFrame:
    """A measurement of each case, to be appended to those before."""
    gain = F.greatest(F.lit(0.0), (F.col("observed") - F.col("during")) * F.col("elapsed"))
    return states(windows(ctx, sales)).select("case_id", "sku", "baseline", "during", "observed", _round(F.col("observed") - F.col("baseline"), 4).alias("delta"), _round(gain, 2).alias("recovery_amount"), "elapsed", "monitoring", "outcome_state")


def upserted(outcomes: DataFrame, measured: DataFrame, now: Column) -> DataFrame:
    """Outcomes (investigation_id, observed_recovery, ...) after ``measured``: one for each investigation; a recovery that was entered stays."""
    m = measured.select(
        F.col("case_id").alias("investigation_id"), F.lit(True).alias("new"), F.col("outcome_state").alias("m_state"), F.when(F.col("outcome_state").isin("observed_recovery", "partial_recovery"), F.col("recovery_amount")).alias("gain"),
        F.when(F.col("monitoring"), now + F.make_dt_interval(days=F.lit(1))).alias("m_next"),
    )
    rows, full = outcomes.join(m, "investigation_id", "full"), F.col("m_state") == "observed_recovery"
    pick = lambda new, old: F.when(F.col("new"), new).otherwise(F.col(old)).alias(old)
    return rows.select(
        "investigation_id", pick(F.col("m_state"), "outcome_state"), F.coalesce(F.col("observed_recovery").cast("double"), "gain").alias("observed_recovery"),
        pick(F.when(full, "estimated").otherwise("not_attempted"), "attribution_status"), pick(F.when(full, "moderate").otherwise("insufficient"), "evidence_strength"), pick(F.col("m_next"), "next_measurement_at"),
    )


def recorded(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """Outcomes after an analyst's ``records``: fields that a record leaves null stay as they were."""
    fields = [c for c in records.columns if c != "investigation_id"]
    r = records.select("investigation_id", *(F.col(c).alias(f"r_{c}") for c in fields))
    return outcomes.join(r, "investigation_id", "full").withColumns({c: F.coalesce(f"r_{c}", c) if c in outcomes.columns else F.col(f"r_{c}") for c in fields}).drop(*(f"r_{c}" for c in fields))


def feedback(anomalies: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """Anomalies after ``records``: those of an investigation recorded as a false positive are flagged and dismissed."""
    false = records.where("was_false_positive").select("investigation_id", F.lit(True).alias("fp")).distinct()
    rows = anomalies.join(false, "investigation_id", "left")
    return rows.withColumns({"is_false_positive": F.col("is_false_positive") | F.coalesce("fp", F.lit(False)), "dismissed_at": F.when(F.col("fp"), now).otherwise(F.col("dismissed_at").cast("timestamp_ntz"))}).drop("fp")


def record(ctx: Context, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, investigations and anomalies after an analyst's ``records``, one for each investigation.

    What was at risk is taken from the investigation where a record leaves it
    out; a recovery that is entered is written to the investigation too; a
    false positive dismisses the investigation's anomalies once: not where the
    outcome says that its rules have been told.
    """
    old, i = ctx.table("outcomes"), ctx.table("investigations")
    at_risk = i.select(F.col("id").alias("investigation_id"), F.col("revenue_at_risk").alias("_estimate"))
    entered = F.col("revenue_at_risk") if "revenue_at_risk" in records.columns else F.lit(None)
    r = records.join(at_risk, "investigation_id").withColumn("revenue_at_risk", F.coalesce(entered, F.col("_estimate"))).drop("_estimate").withColumn("recorded_at", ctx.clock())
    told = old.where("rule_feedback_sent").select("investigation_id") if "rule_feedback_sent" in old.columns else old.select("investigation_id").limit(0)
    fresh = r.where(F.coalesce("was_false_positive", F.lit(False))).join(told, "investigation_id", "left_anti")
    after = recorded(old, r).join(fresh.select("investigation_id", F.lit(True).alias("_sent")), "investigation_id", "left")
    sent = F.coalesce("_sent", F.col("rule_feedback_sent") if "rule_feedback_sent" in old.columns else F.lit(False), F.lit(False))
    back = r.where("observed_recovery IS NOT NULL").select(F.col("investigation_id").alias("id"), F.col("observed_recovery").alias("_back"))
    cases = i.join(back, "id", "left").withColumn("observed_recovery", F.coalesce("_back", "observed_recovery") if "observed_recovery" in i.columns else F.col("_back")).drop("_back")
    return after.withColumn("rule_feedback_sent", sent).drop("_sent"), cases, feedback(ctx.table("anomalies"), fresh, ctx.clock())


def net_impact(ctx: Context) -> DataFrame:
    """Recovered less cost, and the recovery rate; null without a recovery or anything at risk."""
    o = ctx.table("outcomes")
    rate = F.when(F.col("revenue_at_risk") > 0, F.col("revenue_recovered").cast("double") / F.col("revenue_at_risk").cast("double") * 100)
    return o.select("investigation_id", (F.col("revenue_recovered") - F.coalesce("action_cost", F.lit(0))).alias("net_impact"), rate.alias("recovery_rate"))
