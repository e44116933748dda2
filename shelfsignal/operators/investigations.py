"""Correlation of anomalies into investigations, suppression, escalation, bulk actions and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import hours_between, priority_name, priority_rank, rule_label, severity_rank

_OPEN = ("open", "in_progress")
# How sure a reply may be.
CONFIDENCES = ("established", "probable", "suspected", "unknown")


def candidates(ctx: Context) -> DataFrame:
    """Undismissed anomalies that belong to no investigation."""
    return ctx.table("anomalies").where("dismissed_at IS NULL AND investigation_id IS NULL")


def active_suppressions(ctx: Context) -> DataFrame:
    now = ctx.clock()
    return ctx.table("suppressions").where(F.col("active") & (F.col("starts_at").cast("timestamp_ntz") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at").cast("timestamp_ntz") > now)))


def suppression_matches(ctx: Context, anomalies: DataFrame | None = None) -> DataFrame:
    """The first (smallest id) active suppression of each candidate: its rule, and store or SKU where the scope names them."""
    a = candidates(ctx) if anomalies is None else anomalies
    s = active_suppressions(ctx).select(F.col("id").alias("suppression_id"), "scope_type", F.col("rule_type").alias("s_rule"), F.col("store_id").alias("s_store"), F.col("sku").alias("s_sku"))
    scope = F.col("scope_type")
    store, sku = F.col("store_id") == F.col("s_store"), F.col("sku") == F.col("s_sku")
    match = (F.col("rule_type") == F.col("s_rule")) & ((scope == "rule") | ((scope == "rule_store") & store) | ((scope == "rule_sku") & sku) | ((scope == "rule_store_sku") & store & sku))
    return a.join(s, match).groupBy(F.col("id").alias("anomaly_id")).agg(F.min("suppression_id").alias("suppression_id"))


def suppression_counts(ctx: Context) -> DataFrame:
    return suppression_matches(ctx).groupBy("suppression_id").agg(F.count("*").alias("matched"))


def suppressions_counted(ctx: Context) -> DataFrame:
    """The suppressions after a run: matches added, and when the last one was."""
    n = suppression_counts(ctx).withColumnRenamed("suppression_id", "id")
    rows = ctx.table("suppressions").join(n, "id", "left")
    hit = F.col("matched").isNotNull()
    last = F.col("last_matched_at").cast("timestamp_ntz") if "last_matched_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    return rows.withColumns({"match_count": F.coalesce("match_count", F.lit(0)) + F.coalesce("matched", F.lit(0)), "last_matched_at": F.when(hit, ctx.clock()).otherwise(last)}).drop("matched")


def correlation_groups(ctx: Context) -> DataFrame:
    """Unsuppressed candidates by SKU (null-safe): the newest open investigation of the last seven days, or a new one."""
    a = candidates(ctx).join(suppression_matches(ctx), F.col("id") == F.col("anomaly_id"), "left_anti")
    first = F.min_by(F.struct("rule_type", "store_id", "severity"), "id")
    groups = a.groupBy("sku").agg(F.count("*").alias("anomalies"), first.alias("first"), F.max(severity_rank(F.col("severity"))).alias("worst"), F.sum("revenue_impact").alias("impact"))
    opened = F.col("opened_at").cast("timestamp_ntz")
    open_ = ctx.table("investigations").where(F.col("status").isin(*_OPEN) & (opened >= ctx.clock(24 * 7))).groupBy("primary_sku").agg(F.max_by("id", F.struct("opened_at", "id")).alias("investigation_id"))
    rows = groups.join(open_, groups.sku.eqNullSafe(open_.primary_sku), "left")
    stores = ctx.table("stores").select(F.col("id").alias("s_id"), F.col("name").alias("store"))
    team = ctx.table("teams").where("is_default").agg(F.min("id").alias("team_id"))
    rows = rows.join(stores, F.col("first.store_id") == F.col("s_id"), "left").crossJoin(team)  # one row
    title = F.concat_ws(" \u2014 ", rule_label(F.col("first.rule_type")), F.concat(F.lit("SKU "), F.col("sku")), F.concat(F.lit("@ "), F.col("store")))
    priority = F.when(F.col("worst") == 3, "high").when(F.col("worst") == 2, "medium").otherwise("low")
    return rows.select("sku", "investigation_id", F.when(F.col("investigation_id").isNull(), title).alias("new_title"), F.when(F.col("investigation_id").isNull(), F.col("team_id")).alias("team_id"), priority.alias("priority"), "anomalies", F.coalesce(F.round("impact", 2), F.lit(0)).alias("revenue_at_risk"), F.col("first.store_id").alias("first_store_id"))


def entities(ctx: Context) -> DataFrame:
    """Distinct rule, SKU and store entities of linked anomalies; a store by its name, or its number where it has no row."""
    stores = ctx.table("stores").select(F.col("id").alias("store_id"), F.col("name").alias("store_name"))
    a = ctx.table("anomalies").where("investigation_id IS NOT NULL").join(stores, "store_id", "left")
    entity = lambda kind, key: F.when(key.isNotNull(), F.struct(F.lit(kind).alias("entity_type"), key.cast("string").alias("entity_key")))
    each = F.explode(F.array_compact(F.array(entity("rule", F.col("rule_type")), entity("sku", F.col("sku")), entity("store", F.coalesce("store_name", F.col("store_id").cast("string")))))).alias("e")
    return a.select("investigation_id", each).select("investigation_id", "e.*").groupBy("investigation_id", "entity_type", "entity_key").agg(F.count("*").alias("anomalies"))


def rollup(ctx: Context) -> DataFrame:
    """Anomaly count, revenue at risk and escalated priority of each investigation with anomalies; dismissed ones are members too."""
    a = ctx.table("anomalies").where("investigation_id IS NOT NULL")
    a = a.groupBy("investigation_id").agg(F.count("*").alias("anomaly_count"), F.round(F.coalesce(F.sum("revenue_impact"), F.lit(0)), 2).alias("revenue_at_risk"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    rows = ctx.table("investigations").select("id", "priority").join(a, F.col("id") == F.col("investigation_id"))
    return rows.select("id", "anomaly_count", "revenue_at_risk", priority_name(F.greatest(priority_rank(F.col("priority")), F.col("worst"))).alias("priority"))


def narration_candidates(ctx: Context) -> DataFrame:
    """Open investigations never narrated, or with newer evidence."""
    e = ctx.table("evidence").groupBy("investigation_id").agg(F.max("observed_at").alias("last_evidence"))
    rows = ctx.table("investigations").where(F.col("status").isin(*_OPEN)).join(e, F.col("id") == F.col("investigation_id"), "left")
    return rows.where("narrated_at IS NULL OR last_evidence > narrated_at").select("id", "status", "narrated_at", "last_evidence")


def parse_narration(replies: DataFrame) -> DataFrame:
    """summary and confidence of a model's reply: fences stripped, the first {…} block read; unknown for any other confidence."""
    body = F.regexp_extract(F.regexp_replace("reply", r"(?i)```(json)?\s*", ""), r"(?s)(\{.*\})", 1)
    rows = replies.withColumn("j", F.from_json(body, "summary string, confidence string", {"mode": "PERMISSIVE"}))
    known = F.col("j.confidence").isin(*CONFIDENCES)
    return rows.select(*replies.columns, F.col("j.summary").alias("summary"), F.when(known, F.col("j.confidence")).otherwise("unknown").alias("confidence"))


def suppressions_expired(ctx: Context) -> DataFrame:
    """All suppressions after those that are due have ended."""
    due = F.col("active") & (F.col("expires_at").cast("timestamp_ntz") <= ctx.clock())
    rows = ctx.table("suppressions")
    ended = F.col("ended_at").cast("timestamp_ntz") if "ended_at" in rows.columns else F.lit(None).cast("timestamp_ntz")
    return rows.withColumn("_due", F.coalesce(due, F.lit(False))).withColumns({"ended_at": F.when(F.col("_due"), ctx.clock()).otherwise(ended), "active": F.col("active") & ~F.col("_due")}).drop("_due")


def snoozes_cleared(ctx: Context) -> DataFrame:
    """All investigations after snoozes that have ended are cleared, with their reason, notes, user and time."""
    rows = ctx.table("investigations")
    over = F.coalesce(F.col("snoozed_until").cast("timestamp_ntz") <= ctx.clock(), F.lit(False))
    return rows.withColumn("_over", over).withColumns({c: F.when(~F.col("_over"), F.col(c)) for c in _SNOOZE if c in rows.columns}).drop("_over")


def expired_suppressions(ctx: Context) -> DataFrame:
    return ctx.table("suppressions").where(F.col("active") & (F.col("expires_at").cast("timestamp_ntz") <= ctx.clock())).select("id", "rule_type", "expires_at")


def suppression_rows(requests: DataFrame, now: Column) -> DataFrame:
    """New suppressions from ``requests``: they begin now and end after ``default_expiry_days`` (30 where null; 0 for never) unless a time is given."""
    days = F.coalesce("default_expiry_days", F.lit(30))
    ends = F.coalesce(F.col("expires_at").cast("timestamp_ntz"), F.when(days > 0, now + F.make_dt_interval(days=days)))
    return requests.withColumns({"starts_at": F.coalesce(F.col("starts_at").cast("timestamp_ntz"), now), "expires_at": ends, "active": F.lit(True)}).drop("default_expiry_days")


def woken(ctx: Context) -> DataFrame:
    """Investigations whose snooze has ended."""
    until = F.col("snoozed_until").cast("timestamp_ntz")
    return ctx.table("investigations").where(until <= ctx.clock()).select("id", "status", "snoozed_until")


def snooze_until(now: Column, choice: Column, custom: Column) -> Column:
    """End of a snooze: 24h, 3d, 7d, 30d, or the custom time."""
    hours = F.when(choice == "24h", 24).when(choice == "3d", 72).when(choice == "7d", 168).when(choice == "30d", 720)
    return F.coalesce(now + F.make_interval(hours=hours), custom)


def _open_hours(ctx: Context, column: str) -> Column:
    return hours_between(ctx.clock(), F.col(column))


def escalation_matches(ctx: Context, refire_hours: float = 24) -> DataFrame:
    """The first rule (by sort_order) that each open investigation meets, but none that fired within a day.

    Rules are configuration, a handful for each tenant; the join is on the tenant.
    """
    done = ctx.table("actions").where("status = 'completed'").select(F.col("investigation_id").alias("a_id")).distinct()
    i = ctx.table("investigations").where(F.col("status").isin(*_OPEN)).join(done, F.col("id") == F.col("a_id"), "left")
    rules = ctx.table("escalation_rules").select("tenant_id", F.col("id").alias("rule_id"), "trigger_type", "trigger_value", "min_priority", "sort_order")
    limit = F.col("trigger_value").try_cast("double")
    kind = F.col("trigger_type")
    fires = (
        ((kind == "time_open") & (_open_hours(ctx, "opened_at") >= F.coalesce(limit, F.lit(48.0))))
        | ((kind == "unassigned") & F.col("assigned_team_id").isNull() & (_open_hours(ctx, "opened_at") >= F.coalesce(limit, F.lit(24.0))))
        | ((kind == "no_action") & (F.col("status") == "in_progress") & F.col("a_id").isNull() & (hours_between(ctx.clock(), F.coalesce("assigned_at", "opened_at")) >= F.coalesce(limit, F.lit(48.0))))
        | ((kind == "priority_threshold") & (priority_rank(F.col("priority")) >= priority_rank(F.coalesce("trigger_value", F.lit("high")))))
    )
    allowed = F.col("min_priority").isNull() | (priority_rank(F.col("priority")) >= priority_rank(F.col("min_priority")))
    rows = i.join(rules, "tenant_id").where(fires & allowed)
    fired = ctx.table("escalation_events").where(hours_between(ctx.clock(), F.col("fired_at")) < refire_hours).select(F.col("investigation_id").alias("id"), "rule_id")
    rows = rows.join(fired, ["id", "rule_id"], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("sort_order", "rule_id"))).where("_r = 1")
    return rows.select(F.col("id").alias("investigation_id"), "rule_id", "trigger_type", "priority", "assigned_at")


def escalation_effects(ctx: Context) -> DataFrame:
    """What each rule that fires does, in a row that is the event as well: the rule's targets whatever it does, the priority before and after, the team, user and time of the assignment that follows, and a notice to the lead."""
    r = ctx.table("escalation_rules").select(F.col("id").alias("rule_id"), "escalation_action", F.col("target_team_id").alias("to_team_id"), F.col("target_user_id").alias("to_user_id"))
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "title")
    rows, does = escalation_matches(ctx).join(r, "rule_id").join(i, "investigation_id"), F.col("escalation_action")
    up = priority_name(F.least(F.coalesce(priority_rank(F.col("priority")), F.lit(2)) + 1, F.lit(4)))
    team, user = F.when(does == "reassign_team", F.col("to_team_id")), F.when(does == "reassign_user", F.col("to_user_id"))
    assigned = F.coalesce(F.col("assigned_at").cast("timestamp_ntz"), F.when(team.isNotNull() | user.isNotNull(), ctx.clock()))
    notice = F.when(does == "notify_lead", F.concat(F.lit("NOTIFY LEAD: investigation #"), F.col("investigation_id").cast("string"), F.lit(" \u2014 "), F.coalesce("title", F.lit(""))))
    return rows.select(
        "investigation_id", "rule_id", "trigger_type", "escalation_action", "to_team_id", "to_user_id", F.col("priority").alias("from_priority"), F.when(does == "elevate_priority", up).otherwise(F.col("priority")).alias("to_priority"),
        team.alias("assigned_team_id"), user.alias("assigned_user_id"), assigned.alias("assigned_at"), notice.alias("notice"), ctx.clock().alias("triggered_at"),
    )


def escalated(ctx: Context) -> DataFrame:
    """The investigations after all rules that fire: team, user, priority and time of assignment."""
    e = escalation_effects(ctx).select(F.col("investigation_id").alias("id"), *(F.col(c).alias(f"e_{c}") for c in ("assigned_team_id", "assigned_user_id", "assigned_at", "to_priority")))
    i = ctx.table("investigations")
    i = i if "assigned_user_id" in i.columns else i.withColumn("assigned_user_id", F.lit(None).cast("long"))
    rows = i.join(e, "id", "left")
    new = {"assigned_team_id": F.coalesce("e_assigned_team_id", "assigned_team_id"), "assigned_user_id": F.coalesce("e_assigned_user_id", "assigned_user_id"), "priority": F.coalesce("e_to_priority", "priority"), "assigned_at": F.coalesce("e_assigned_at", F.col("assigned_at").cast("timestamp_ntz"))}
    return rows.withColumns(new).select(*i.columns)


# Bulk actions on investigations, and why an id fails that isn't one of the tenant's.
BULK_ACTIONS = ("assign_to_me", "reassign_team", "change_priority", "snooze", "dismiss")
NOT_FOUND = "Not found in tenant scope"
_SNOOZE = ("snoozed_until", "snooze_reason", "snooze_notes", "snoozed_by", "snoozed_at")


def bulk(ctx: Context, ids: DataFrame, action: str, user_id: int, team_id: int = 0, priority: str = "medium", duration: str = "7d", until=None, reason: str = "known_issue", notes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The investigations after a bulk action on ``ids`` (id), and a row for each of these with its failure, null where it succeeded.

    A team of 0 takes the team away; dismissing closes. An action that is none
    fails for each investigation that there is.
    """
    i, now = ctx.table("investigations"), ctx.clock()
    end = snooze_until(now, F.lit(duration), F.lit(until).cast("timestamp_ntz"))
    changes = {
        "assign_to_me": {"assigned_user_id": F.lit(user_id), "assigned_at": F.coalesce(F.col("assigned_at").cast("timestamp_ntz"), now)},
        "reassign_team": {"assigned_team_id": F.lit(team_id or None), "assigned_at": now},
        "change_priority": {"priority": F.lit(priority)},
        "snooze": {"snoozed_until": end, "snooze_reason": F.lit(reason), "snooze_notes": F.lit(notes), "snoozed_by": F.lit(user_id), "snoozed_at": now},
        "dismiss": {"status": F.lit("closed"), "closed_at": now},
    }.get(action, {})
    asked = ids.select("id").distinct()
    hit = i.join(asked.withColumn("_asked", F.lit(True)), "id", "left")
    types = {f.name: f.dataType for f in i.schema.fields}
    kinds = {"assigned_user_id": "long", "snooze_reason": "string", "snooze_notes": "string", "snoozed_by": "long", "snoozed_at": "timestamp_ntz", "closed_at": "timestamp_ntz"}
    cast = lambda c, k: c.cast(types.get(k, kinds.get(k, "string")))
    after = hit.withColumns({k: F.when(F.col("_asked"), cast(v, k)).otherwise(F.col(k) if k in types else cast(F.lit(None), k)) for k, v in changes.items()}).drop("_asked")
    there = asked.join(i.select("id").withColumn("_there", F.lit(True)), "id", "left")
    failure = F.when(F.col("_there").isNull(), NOT_FOUND).when(F.lit(action not in BULK_ACTIONS), f"Unknown bulk action: {action}")
    return after.select(*i.columns, *(k for k in changes if k not in types)), there.select("id", failure.alias("failure"))


def bulk_counts(results: DataFrame) -> DataFrame:
    """succeeded and failed of a bulk action's results."""
    return results.agg(F.count_if(F.col("failure").isNull()).alias("succeeded"), F.count_if(F.col("failure").isNotNull()).alias("failed"))


def mentions(ctx: Context) -> DataFrame:
    """Users that a comment mentions by name without spaces, first name or e-mail's local part; never its author."""
    found = F.regexp_extract_all(F.col("body"), F.lit(r"@([A-Za-z][A-Za-z0-9._\-]{1,50})"), F.lit(1))
    c = ctx.table("comments").select(F.col("id").alias("comment_id"), "author_id", F.explode(found).alias("token")).withColumn("token", F.lower("token"))
    u = ctx.table("users").select(F.col("id").alias("user_id"), F.explode(F.array_distinct(F.array(F.lower(F.replace("name", F.lit(" "), F.lit(""))), F.lower(F.split_part("name", F.lit(" "), F.lit(1))), F.lower(F.split_part("email", F.lit("@"), F.lit(1)))))).alias("token"))
    return c.join(u, "token").where("user_id <> author_id").select("comment_id", "user_id").distinct()


def all_mentions(ctx: Context) -> DataFrame:
    """Who each comment mentions: users named in it or explicitly, teams, and (via the team) their members: comment_id, team_id, user_id; each once, direct ones first."""
    direct = mentions(ctx).unionByName(ctx.table("comment_users").select("comment_id", "user_id")).distinct().withColumn("team_id", F.lit(None).cast("long"))
    teams = ctx.table("comment_teams").join(ctx.table("teams").select(F.col("id").alias("team_id")), "team_id", "left_semi").select("comment_id", "team_id").distinct()
    members = teams.join(ctx.table("team_members").select("team_id", "user_id"), "team_id").select("comment_id", "team_id", "user_id")
    return direct.select("comment_id", "team_id", "user_id").unionByName(members).unionByName(teams.withColumn("user_id", F.lit(None).cast("long")))


def mentioned_users(ctx: Context) -> DataFrame:
    """The users to tell of each comment: mentioned themselves or through a team, once, never its author."""
    author = ctx.table("comments").select(F.col("id").alias("comment_id"), "author_id")
    return all_mentions(ctx).where("user_id IS NOT NULL").select("comment_id", "user_id").distinct().join(author, "comment_id").where("author_id IS NULL OR user_id <> author_id").drop("author_id")
