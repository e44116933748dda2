"""Watched investigations: what changed since a watch last looked, who is told, once each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context

# Triggers of a watch that names none, and what counts as a material change of revenue at risk.
DEFAULT_TRIGGERS = ("status_change", "escalation", "action_taken", "material_impact_change", "recovery", "resolution")
MATERIAL_SHARE, MATERIAL_AMOUNT = 0.10, 100
STATE = ("status", "priority", "actions", "completed", "overdue", "escalations", "at_risk", "recovered")


def snapshot(ctx: Context) -> DataFrame:
    """What a watch compares: status, priority, counts of actions and escalations, money; and the next action due."""
    live = ~F.col("status").isin("completed", "cancelled")
    overdue = live & (F.col("due_at").cast("timestamp_ntz") < ctx.clock())
    a = ctx.table("actions").groupBy("investigation_id").agg(F.count("*").alias("actions"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(overdue).alias("overdue"), F.min(F.when(live, F.col("due_at"))).alias("next_due"))
    e = ctx.table("escalation_events").groupBy("investigation_id").agg(F.count("*").alias("escalations"))
    o = ctx.table("outcomes").select("investigation_id", "revenue_recovered")
    rows = ctx.table("investigations").withColumnRenamed("id", "investigation_id").join(a, "investigation_id", "left").join(e, "investigation_id", "left").join(o, "investigation_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("investigation_id", "title", "status", "priority", *(zero(c).alias(c) for c in ("actions", "completed", "overdue", "escalations")), zero("revenue_at_risk").alias("at_risk"), zero("revenue_recovered").alias("recovered"), "next_due")


def next_expected(ctx: Context) -> DataFrame:
    """The next thing to happen to each investigation: an action due, else what an open one waits for."""
    s = snapshot(ctx)
    text = F.when(F.col("next_due").isNotNull(), F.concat(F.lit("Action due "), F.col("next_due").cast("date").cast("string"))).when(F.col("status").isin("open", "in_progress"), "Awaiting action / resolution")
    return s.select("investigation_id", text.alias("next_event"))


def _live(ctx: Context) -> Column:
    return F.col("active") & ((F.col("mode") != "until_date") | F.col("until_date").isNull() | (F.col("until_date").cast("timestamp_ntz") > ctx.clock()))


def _money(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def events(ctx: Context) -> DataFrame:
    """Every event of each live watch since its last state (``last_…`` columns), with its signature."""
    w = ctx.table("watches").where(_live(ctx))
    w = w.select(F.col("id").alias("watch_id"), "tenant_id", "user_id", "team_id", "investigation_id", "triggers", *(F.coalesce(F.col(f"last_{c}"), F.lit(0)).alias(f"last_{c}") if c not in ("status", "priority") else F.col(f"last_{c}") for c in STATE))
    rows = w.join(snapshot(ctx), "investigation_id")
    now, last = F.col, lambda c: F.col(f"last_{c}")
    moved = F.abs(now("at_risk") - last("at_risk"))
    changed = last("status").isNotNull() & (now("status") != last("status"))
    event = lambda trigger, when, *value: F.when(when, F.struct(F.lit(trigger).alias("event"), F.concat(F.lit({"material_impact_change": "material"}.get(trigger, trigger) + ":"), *value).alias("signature")))
    each = F.array_compact(
        F.array(
            event("status_change", changed, last("status"), F.lit("->"), now("status")),
            event("resolution", changed & now("status").isin("resolved", "closed"), now("status")),
            event("escalation", now("escalations") > last("escalations"), now("escalations").cast("string")),
            event("action_taken", now("completed") > last("completed"), now("completed").cast("string")),
            event("overdue", (now("overdue") > 0) & (last("overdue") == 0), F.lit(ctx.now.date().isoformat())),
            event("material_impact_change", (last("at_risk") > 0) & (moved >= MATERIAL_AMOUNT) & (moved.cast("double") >= MATERIAL_SHARE * last("at_risk").cast("double")), _money(now("at_risk"))),
            event("recovery", now("recovered") > last("recovered"), _money(now("recovered"))),
        )
    )
    return rows.select("watch_id", "tenant_id", "user_id", "team_id", "investigation_id", "triggers", F.explode(each).alias("e")).select("watch_id", "tenant_id", "user_id", "team_id", "investigation_id", "triggers", "e.*")


def wanted(trigger: Column) -> Column:
    """Whether a watch's own triggers, or the default ones where it has none, hold ``trigger``."""
    own = F.when(F.size("triggers") > 0, F.col("triggers")).otherwise(F.array(*map(F.lit, DEFAULT_TRIGGERS)))
    return F.array_contains(own, trigger)


def notifications(ctx: Context) -> DataFrame:
    """Events that their watch wants and that its ledger (watch_id, signature) does not hold: to be sent, and appended to the ledger."""
    found = events(ctx).where(wanted(F.col("event"))).dropDuplicates(["watch_id", "signature"])
    return found.join(ctx.table("watch_ledger").select("watch_id", "signature"), ["watch_id", "signature"], "left_anti").drop("triggers")


def recipients(ctx: Context, rows: DataFrame) -> DataFrame:
    """``rows`` of watches with a row for each user who is told: the watcher, or the members of the team; each once."""
    members = ctx.table("team_members").select("team_id", F.col("user_id").alias("member_id"))
    told = rows.join(members, "team_id", "left").withColumn("recipient_id", F.coalesce("user_id", "member_id")).where("recipient_id IS NOT NULL")
    return told.drop("member_id").distinct()


def evaluated(ctx: Context) -> DataFrame:
    """The watches after an evaluation: the current state as their last one; ended where the date has passed or the watched thing is over."""
    s = snapshot(ctx)
    w = ctx.table("watches").where("active").drop(*(f"last_{c}" for c in STATE))
    rows = w.join(s.select("investigation_id", *(F.col(c).alias(f"last_{c}") for c in STATE)), "investigation_id", "left")
    over = ~_live(ctx) | ((F.col("mode") == "until_resolved") & F.col("last_status").isin("resolved", "closed")) | F.col("last_status").isNull()
    return rows.withColumn("ended_at", F.when(over, ctx.clock())).withColumn("active", ~over)


def expiry(ctx: Context) -> DataFrame:
    """Watches that end, and why: no investigation, date passed, or resolved."""
    i = ctx.table("investigations").select(F.col("id").alias("i_id"), "status")
    rows = ctx.table("watches").where("active").join(i, F.col("investigation_id") == F.col("i_id"), "left")
    why = F.when(F.col("i_id").isNull(), "missing").when(~_live(ctx), "date").when((F.col("mode") == "until_resolved") & F.col("status").isin("resolved", "closed"), "resolved")
    return rows.select(F.col("id").alias("watch_id"), why.alias("reason")).where("reason IS NOT NULL")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a.investigation_id == b.investigation_id) & a.user_id.eqNullSafe(b.user_id) & a.team_id.eqNullSafe(b.team_id)


def start(ctx: Context, requests: DataFrame) -> DataFrame:
    """All watches after ``requests`` (investigation_id, user_id or team_id, mode, until_date, triggers): one for each investigation and watcher, begun anew from the current state."""
    state = snapshot(ctx).select("investigation_id", *(F.col(c).alias(f"last_{c}") for c in STATE))
    asked = requests.dropDuplicates(["investigation_id", "user_id", "team_id"]).join(state, "investigation_id")
    asked = asked.withColumn("until_date", F.when(F.col("mode") == "until_date", F.col("until_date"))).withColumn("triggers", F.when(F.size("triggers") > 0, F.col("triggers")).otherwise(F.array(*map(F.lit, DEFAULT_TRIGGERS))))
    old = ctx.table("watches")
    ids = old.select("id", F.col("investigation_id").alias("i"), F.col("user_id").alias("u"), F.col("team_id").alias("t"))
    asked = asked.join(ids, (F.col("investigation_id") == F.col("i")) & F.col("user_id").eqNullSafe(F.col("u")) & F.col("team_id").eqNullSafe(F.col("t")), "left").drop("i", "u", "t")
    asked = asked.withColumns({"active": F.lit(True), "ended_at": F.lit(None).cast("timestamp_ntz")})
    return old.join(asked, _same(old, asked), "left_anti").unionByName(asked, allowMissingColumns=True)


def stop(ctx: Context, requests: DataFrame) -> DataFrame:
    """All watches after those of ``requests`` (investigation_id, user_id or team_id) have ended."""
    old, asked = ctx.table("watches"), requests.select("investigation_id", "user_id", "team_id").distinct().alias("asked")
    hit = old.join(asked, _same(old, asked), "left_semi").where("active").select("id", F.lit(True).alias("hit"))
    rows = old.join(hit, "id", "left")
    return rows.withColumn("ended_at", F.when(F.col("hit"), ctx.clock())).withColumn("active", F.col("active") & F.col("hit").isNull()).drop("hit")


def of_user(ctx: Context, user_id: int) -> DataFrame:
    """A user's live watches, those of the user's teams included, with the investigation's state, what comes next and the last notification."""
    teams = ctx.table("team_members").where(F.col("user_id") == user_id).select("team_id", F.lit(True).alias("member"))
    w = ctx.table("watches").where("active").join(teams, "team_id", "left").where((F.col("user_id") == user_id) | F.col("member"))
    sent = ctx.table("watch_ledger").groupBy("watch_id").agg(F.max_by("signature", F.struct("sent_at", "signature")).alias("last_notification"))
    rows = w.select(F.col("id").alias("watch_id"), "investigation_id", "team_id", "mode").join(snapshot(ctx).select("investigation_id", "status", "overdue", F.col("next_due").cast("date").alias("next_due")), "investigation_id", "left")
    return rows.join(sent, "watch_id", "left")


def comment_notifications(ctx: Context) -> DataFrame:
    """Users told of each new comment through a watch that wants comments: not the author, not those the comment mentions; once for each watch and comment."""
    from .investigations import mentions

    c = ctx.table("comments").select(F.col("id").alias("comment_id"), "author_id", "investigation_id")
    w = ctx.table("watches").where(F.col("active") & wanted(F.lit("comment"))).select(F.col("id").alias("watch_id"), "investigation_id", "user_id", "team_id")
    rows = c.join(w, "investigation_id").withColumn("signature", F.concat(F.lit("comment:"), F.col("comment_id").cast("string")))
    rows = rows.join(ctx.table("watch_ledger").select("watch_id", "signature"), ["watch_id", "signature"], "left_anti")
    told = recipients(ctx, rows).where("recipient_id <> author_id")
    named = mentions(ctx).select("comment_id", F.col("user_id").alias("recipient_id"))
    return told.join(named, ["comment_id", "recipient_id"], "left_anti").select("watch_id", "comment_id", "recipient_id", "signature")
