"""Queries and oracle SQL of state, correlation, evidence, lifecycle, metrics and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.columns import short_money
from ..operators import evidence, investigations, metrics, outcomes, reports, state, watches
from .registry import Catalogue, r
from .rules_catalogue import T

CAT = Catalogue()
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
OPEN = "status IN ('open', 'in_progress')"
ACTIVE = "status IN ('unassigned', 'assigned', 'acknowledged', 'in_progress', 'blocked')"
SEV = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
PRI = "CASE {} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
NAME = "CASE {} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END"
#: What a rule is called, by SQL: words of its key, but for five.
_LABEL = "CASE {0} WHEN 'po_overdue' THEN 'PO Overdue' WHEN 'sku_master_drift' THEN 'SKU Master Drift' WHEN 'slow_moving_capital' THEN 'Slow-Moving Capital' WHEN 'multi_location_imbalance' THEN 'Multi-Location Imbalance' WHEN 'duplicate_transaction_ids' THEN 'Duplicate Transaction IDs' ELSE array_to_string(list_transform(string_split({0}, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') END"
_PART = {"sales": "part_sales", "products": "part_products"}


def hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3.6e9)"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100 + 1e-9, 1) END"


# State


def _runs(c):
    """Open anomalies of even ids as the old state, those of odd ids as a new run's detections."""
    a = c.table("anomalies")
    new = a.where("id % 2 = 1 AND dismissed_at IS NULL").select("rule_type", "severity", F.when(F.col("id") % 10 != 3, F.col("sku")).alias("sku"), "store_id", "revenue_impact", F.col("id").cast("string").alias("context"))
    return a.where("id % 2 = 0"), new


_OLD = "SELECT * FROM (SELECT id, rule_type, sku, store_id, severity, investigation_id, row_number() OVER (PARTITION BY rule_type, sku, store_id ORDER BY id DESC) AS k FROM anomalies WHERE dismissed_at IS NULL AND id % 2 = 0) WHERE k = 1"
_NEW = "SELECT rule_type, severity, CASE WHEN id % 10 <> 3 THEN sku END AS sku, store_id, revenue_impact, CAST(id AS VARCHAR) AS context FROM anomalies WHERE dismissed_at IS NULL AND id % 2 = 1"
_KEYED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_type, sku, store_id ORDER BY revenue_impact DESC NULLS LAST, context DESC) AS k FROM ({_NEW}) WHERE sku IS NOT NULL) WHERE k = 1"
CAT.add(
    "anomaly_upsert",
    lambda c: state.upsert_anomalies(*_runs(c)),
    f"""SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.rule_type IS NULL THEN 'stale' ELSE 'update' END AS action, o.id, coalesce(n.rule_type, o.rule_type) AS rule_type, coalesce(n.sku, o.sku) AS sku, coalesce(n.store_id, o.store_id) AS store_id,
      coalesce(n.severity, o.severity) AS severity, o.investigation_id FROM ({_OLD}) o FULL JOIN ({_KEYED}) n ON o.rule_type = n.rule_type AND o.sku = n.sku AND o.store_id = n.store_id
    UNION ALL SELECT 'insert', NULL, rule_type, sku, store_id, severity, NULL FROM ({_NEW}) WHERE sku IS NULL""",
)
CAT.add("stale_anomalies", lambda c: state.upsert_anomalies(*_runs(c)).where("action = 'stale'").select("id"), f"SELECT o.id FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_KEYED}) n WHERE o.rule_type = n.rule_type AND o.sku = n.sku AND o.store_id = n.store_id)")
CAT.add(
    "settings_seed",
    lambda c: state.seed_settings(c.table("anomalies").select("tenant_id").distinct(), c.table("suppressions").select("tenant_id", "rule_type").distinct()),
    "SELECT 1::BIGINT AS tenant_id, rule_type, true AS enabled FROM (SELECT DISTINCT rule_type FROM anomalies) WHERE rule_type NOT IN (SELECT rule_type FROM suppressions)",
)
CAT.add("quick_dismissals", state.quick_dismissals, f"SELECT id, rule_type, sku, abs({hours('dismissed_at', 'detected_at')}) * 60 < 10 AS false_positive_feedback FROM anomalies WHERE dismissed_at IS NOT NULL")

# Correlation
_SUP = f"""SELECT a.id AS anomaly_id, min(s.id) AS suppression_id FROM (SELECT * FROM anomalies WHERE dismissed_at IS NULL AND investigation_id IS NULL) a JOIN (SELECT * FROM suppressions WHERE active AND starts_at <= {NOW} AND (expires_at IS NULL OR expires_at > {NOW})) s
    ON a.rule_type = s.rule_type AND CASE s.scope_type WHEN 'rule' THEN true WHEN 'rule_store' THEN a.store_id = s.store_id WHEN 'rule_sku' THEN a.sku = s.sku ELSE a.store_id = s.store_id AND a.sku = s.sku END GROUP BY a.id"""
CAT.add("correlation_candidates", lambda c: investigations.candidates(c).select("id", "rule_type", "sku"), "SELECT id, rule_type, sku FROM anomalies WHERE dismissed_at IS NULL AND investigation_id IS NULL")
CAT.add("suppression_match", investigations.suppression_matches, _SUP)
CAT.add("suppression_counts", investigations.suppression_counts, f"SELECT suppression_id, count(*) AS matched FROM ({_SUP}) GROUP BY suppression_id")
CAT.add("suppressions_counted", lambda c: investigations.suppressions_counted(c).select("id", "match_count", F.col("last_matched_at").isNotNull().alias("matched")), f"SELECT s.id, s.match_count + coalesce(m.n, 0) AS match_count, m.n IS NOT NULL AS matched FROM suppressions s LEFT JOIN (SELECT suppression_id, count(*) AS n FROM ({_SUP}) GROUP BY 1) m ON m.suppression_id = s.id")
CAT.add("expired_suppressions", lambda c: investigations.expired_suppressions(c).select("id", "rule_type"), f"SELECT id, rule_type FROM suppressions WHERE active AND expires_at <= {NOW}")
CAT.add(
    "correlation_groups",
    lambda c: investigations.correlation_groups(c).drop("first_store_id"),
    f"""WITH c AS (SELECT * FROM anomalies WHERE dismissed_at IS NULL AND investigation_id IS NULL AND id NOT IN (SELECT anomaly_id FROM ({_SUP}))),
    g AS (SELECT sku, count(*) AS n, arg_min(rule_type, id) AS rule, arg_min(store_id, id) AS sid, max({SEV}) AS worst, sum(revenue_impact) AS impact FROM c GROUP BY sku),
    o AS (SELECT primary_sku, arg_max(id, (opened_at, id)) AS iid FROM investigations WHERE {OPEN} AND opened_at >= {NOW} - INTERVAL 7 DAY GROUP BY primary_sku)
    SELECT g.sku, o.iid AS investigation_id, CASE WHEN o.iid IS NULL THEN concat_ws(' \u2014 ', {_LABEL.format('rule')}, 'SKU ' || g.sku, '@ ' || p.name) END AS new_title, CASE WHEN o.iid IS NULL THEN (SELECT min(id) FROM teams WHERE is_default) END AS team_id,
      CASE worst WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, n AS anomalies, {r('coalesce(impact, 0)')} AS revenue_at_risk FROM g LEFT JOIN o ON g.sku IS NOT DISTINCT FROM o.primary_sku LEFT JOIN stores p ON p.id = g.sid""",
)
CAT.add(
    "investigation_entities",
    investigations.entities,
    """SELECT investigation_id, t AS entity_type, k AS entity_key, count(*) AS anomalies FROM (SELECT investigation_id, 'rule' AS t, rule_type AS k FROM anomalies WHERE investigation_id IS NOT NULL UNION ALL SELECT investigation_id, 'sku', sku FROM anomalies WHERE investigation_id IS NOT NULL AND sku IS NOT NULL
    UNION ALL SELECT investigation_id, 'store', coalesce(s.name, CAST(store_id AS VARCHAR)) FROM anomalies LEFT JOIN stores s ON s.id = store_id WHERE investigation_id IS NOT NULL AND store_id IS NOT NULL) GROUP BY ALL""",
)
CAT.add(
    "investigation_rollup",
    investigations.rollup,
    f"SELECT i.id, a.n AS anomaly_count, {r('a.v')} AS revenue_at_risk, {NAME.format('greatest(a.w, ' + PRI.format('i.priority') + ')')} AS priority FROM investigations i JOIN (SELECT investigation_id, count(*) AS n, coalesce(sum(revenue_impact), 0) AS v, max({SEV}) AS w FROM anomalies WHERE investigation_id IS NOT NULL GROUP BY 1) a ON i.id = a.investigation_id",
)
CAT.add(
    "narration_candidates",
    lambda c: investigations.narration_candidates(c).select("id", "status"),
    f"SELECT id, status FROM investigations i WHERE {OPEN} AND (narrated_at IS NULL OR EXISTS (SELECT 1 FROM evidence e WHERE e.investigation_id = i.id AND e.observed_at > i.narrated_at))",
)

# Lifecycle
_DONE = "SELECT DISTINCT investigation_id FROM actions WHERE status = 'completed'"
CAT.add("woken_investigations", lambda c: investigations.woken(c).select("id", "status"), f"SELECT id, status FROM investigations WHERE snoozed_until <= {NOW}")
CAT.add(
    "snooze_ends",
    lambda c: c.table("investigations").select("id", investigations.snooze_until(F.lit(c.now).cast("timestamp_ntz"), F.expr("element_at(array('24h', '3d', '7d', '30d', 'custom'), cast(id % 5 + 1 as int))"), F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")).cast("string").alias("until")),
    "SELECT id, CASE id % 5 WHEN 0 THEN '2024-02-01 00:00:00' WHEN 1 THEN '2024-02-03 00:00:00' WHEN 2 THEN '2024-02-07 00:00:00' WHEN 3 THEN '2024-03-01 00:00:00' ELSE '2024-03-01 00:00:00' END AS until FROM investigations",
)
CAT.add(
    "new_suppressions",
    lambda c: investigations.suppression_rows(c.table("suppressions").select("id", F.lit(None).cast("timestamp_ntz").alias("starts_at"), "expires_at", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 10).alias("default_expiry_days")), c.clock()).select("id", F.col("starts_at").cast("string").alias("starts_at"), F.col("expires_at").cast("string").alias("expires_at"), "active"),
    "SELECT id, '2024-01-31 00:00:00' AS starts_at, CASE WHEN expires_at IS NOT NULL THEN strftime(expires_at, '%Y-%m-%d %H:%M:%S') WHEN id % 3 = 1 THEN '2024-02-10 00:00:00' WHEN id % 3 = 2 THEN '2024-03-01 00:00:00' END AS expires_at, true AS active FROM suppressions",
)
_FIRED = f"""SELECT investigation_id, rule_id, trigger_type, priority, assigned_at FROM (SELECT i.id AS investigation_id, x.id AS rule_id, x.trigger_type, i.priority, i.assigned_at, row_number() OVER (PARTITION BY i.id ORDER BY x.sort_order, x.id) AS k
      FROM (SELECT * FROM investigations WHERE {OPEN}) i JOIN escalation_rules x ON (x.min_priority IS NULL OR {PRI.format('i.priority')} >= {PRI.format('x.min_priority')}) AND CASE x.trigger_type
        WHEN 'time_open' THEN {hours(NOW, 'i.opened_at')} >= coalesce(TRY_CAST(x.trigger_value AS DOUBLE), 48) WHEN 'unassigned' THEN i.assigned_team_id IS NULL AND {hours(NOW, 'i.opened_at')} >= coalesce(TRY_CAST(x.trigger_value AS DOUBLE), 24)
        WHEN 'no_action' THEN i.status = 'in_progress' AND i.id NOT IN ({_DONE}) AND {hours(NOW, 'coalesce(i.assigned_at, i.opened_at)')} >= coalesce(TRY_CAST(x.trigger_value AS DOUBLE), 48) ELSE {PRI.format('i.priority')} >= {PRI.format('x.trigger_value')} END
      WHERE NOT EXISTS (SELECT 1 FROM escalation_events e WHERE e.investigation_id = i.id AND e.rule_id = x.id AND {hours(NOW, 'e.fired_at')} < 24)) WHERE k = 1"""
CAT.add("escalation_matches", lambda c: investigations.escalation_matches(c).drop("assigned_at"), f"SELECT investigation_id, rule_id, trigger_type, priority FROM ({_FIRED})")
CAT.add(
    "escalation_effects",
    lambda c: investigations.escalation_effects(c).select("investigation_id", "rule_id", "escalation_action", "to_team_id", "to_user_id", "from_priority", "to_priority", "notice", F.col("assigned_at").isNotNull().alias("assigned")),
    f"""SELECT f.investigation_id, f.rule_id, x.escalation_action, x.target_team_id AS to_team_id, x.target_user_id AS to_user_id, CASE WHEN x.escalation_action = 'notify_lead' THEN 'NOTIFY LEAD: investigation #' || f.investigation_id || ' — Investigation ' || f.investigation_id END AS notice, f.priority AS from_priority,
      CASE WHEN x.escalation_action = 'elevate_priority' THEN {NAME.format('least(4, ' + PRI.format('f.priority') + ' + 1)')} ELSE f.priority END AS to_priority, f.assigned_at IS NOT NULL OR (x.escalation_action = 'reassign_team' AND x.target_team_id IS NOT NULL) OR (x.escalation_action = 'reassign_user' AND x.target_user_id IS NOT NULL) AS assigned FROM ({_FIRED}) f JOIN escalation_rules x ON x.id = f.rule_id""",
)
_LIVE = f"active AND (mode <> 'until_date' OR until_date IS NULL OR until_date > {NOW})"
_UNDONE = "status NOT IN ('completed', 'cancelled')"
_SNAP = f"""SELECT i.id AS investigation_id, i.title, i.status, i.priority, coalesce(a.n, 0) AS actions, coalesce(a.done, 0) AS completed, coalesce(a.late, 0) AS overdue, coalesce(e.n, 0) AS escalations, coalesce(i.revenue_at_risk, 0) AS at_risk, coalesce(o.revenue_recovered, 0) AS recovered, a.next_due
    FROM investigations i LEFT JOIN (SELECT investigation_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS done, count(*) FILTER (WHERE {_UNDONE} AND due_at < {NOW}) AS late, min(due_at) FILTER (WHERE {_UNDONE}) AS next_due FROM actions GROUP BY 1) a ON a.investigation_id = i.id
    LEFT JOIN (SELECT investigation_id, count(*) AS n FROM escalation_events GROUP BY 1) e ON e.investigation_id = i.id LEFT JOIN outcomes o ON o.investigation_id = i.id"""
CAT.add("watch_snapshot", lambda c: watches.snapshot(c).drop("next_due"), f"SELECT * EXCLUDE (next_due) REPLACE ({r('at_risk')} AS at_risk, {r('recovered')} AS recovered) FROM ({_SNAP})")
CAT.add("watch_next_event", watches.next_expected, f"SELECT investigation_id, CASE WHEN next_due IS NOT NULL THEN 'Action due ' || CAST(next_due AS DATE) WHEN {OPEN} THEN 'Awaiting action / resolution' END AS next_event FROM ({_SNAP})")
_EVENTS = f"""SELECT * FROM (WITH w AS (SELECT x.id AS watch_id, x.user_id, x.team_id, x.triggers, x.last_status, x.last_completed, x.last_overdue, x.last_at_risk, x.last_recovered, x.last_escalations, s.* FROM (SELECT * FROM watches WHERE {_LIVE}) x JOIN ({_SNAP}) s ON x.investigation_id = s.investigation_id),
    e AS (SELECT watch_id, 'status_change' AS event, 'status_change:' || last_status || '->' || status AS signature FROM w WHERE status <> last_status
      UNION ALL SELECT watch_id, 'resolution', 'resolution:' || status FROM w WHERE status <> last_status AND status IN ('resolved', 'closed')
      UNION ALL SELECT watch_id, 'escalation', 'escalation:' || escalations FROM w WHERE escalations > last_escalations
      UNION ALL SELECT watch_id, 'action_taken', 'action_taken:' || completed FROM w WHERE completed > last_completed
      UNION ALL SELECT watch_id, 'overdue', 'overdue:2024-01-31' FROM w WHERE overdue > 0 AND last_overdue = 0
      UNION ALL SELECT watch_id, 'material_impact_change', 'material:' || printf('%.2f', CAST(at_risk AS DOUBLE)) FROM w WHERE last_at_risk > 0 AND abs(at_risk - last_at_risk) >= 100 AND abs(at_risk - last_at_risk) >= 0.1 * last_at_risk
      UNION ALL SELECT watch_id, 'recovery', 'recovery:' || printf('%.2f', CAST(recovered AS DOUBLE)) FROM w WHERE recovered > last_recovered)
    SELECT w.watch_id, w.investigation_id, w.user_id, w.team_id, w.triggers, e.event, e.signature FROM e JOIN w ON e.watch_id = w.watch_id)"""
CAT.add("watch_events", lambda c: watches.events(c).select("watch_id", "investigation_id", "event", "signature"), f"SELECT watch_id, investigation_id, event, signature FROM ({_EVENTS})")
_WANTS = "coalesce(triggers, ['status_change', 'escalation', 'action_taken', 'material_impact_change', 'recovery', 'resolution'])"
_UNSENT = f"SELECT * FROM ({_EVENTS}) n WHERE list_contains({_WANTS}, event) AND NOT EXISTS (SELECT 1 FROM watch_ledger l WHERE l.watch_id = n.watch_id AND l.signature = n.signature)"
CAT.add("watch_notifications", lambda c: watches.notifications(c).select("watch_id", "investigation_id", "event", "signature"), f"SELECT watch_id, investigation_id, event, signature FROM ({_UNSENT})")
CAT.add("watch_recipients", lambda c: watches.recipients(c, watches.notifications(c)).select("watch_id", "signature", "recipient_id"), f"SELECT DISTINCT n.watch_id, n.signature, coalesce(n.user_id, m.user_id) AS recipient_id FROM ({_UNSENT}) n LEFT JOIN team_members m ON m.team_id = n.team_id WHERE coalesce(n.user_id, m.user_id) IS NOT NULL")
CAT.add(
    "watch_expiry",
    watches.expiry,
    f"SELECT w.id AS watch_id, CASE WHEN i.id IS NULL THEN 'missing' WHEN w.mode = 'until_date' AND w.until_date <= {NOW} THEN 'date' ELSE 'resolved' END AS reason FROM watches w LEFT JOIN investigations i ON i.id = w.investigation_id WHERE w.active AND (i.id IS NULL OR (w.mode = 'until_date' AND w.until_date <= {NOW}) OR (w.mode = 'until_resolved' AND i.status IN ('resolved', 'closed')))",
)
CAT.add(
    "watches_after_evaluation",
    lambda c: watches.evaluated(c).select(F.col("id").alias("watch_id"), "last_status", "last_completed", "active"),
    f"SELECT w.id AS watch_id, s.status AS last_status, s.completed AS last_completed, NOT (s.status IS NULL OR (w.mode = 'until_date' AND w.until_date <= {NOW}) OR (w.mode = 'until_resolved' AND s.status IN ('resolved', 'closed'))) AS active FROM watches w LEFT JOIN ({_SNAP}) s ON s.investigation_id = w.investigation_id WHERE w.active",
)
_ASKED = "SELECT id AS investigation_id, CASE WHEN id % 2 = 0 THEN id % 7 END AS user_id, CASE WHEN id % 2 = 1 THEN CAST(1 AS BIGINT) END AS team_id, 'until_date' AS mode FROM investigations WHERE id % 3 = 0"


def _asked(c):
    rows = c.table("investigations").where("id % 3 = 0").select(F.col("id").alias("investigation_id"), F.expr("case when id % 2 = 0 then id % 7 end").alias("user_id"), F.expr("case when id % 2 = 1 then 1L end").alias("team_id"), F.lit("until_date").alias("mode"))
    return rows.withColumns({"until_date": F.lit(dt.datetime(2024, 2, 9)).cast("timestamp_ntz"), "triggers": F.lit(None).cast("array<string>"), "tenant_id": F.lit(1).cast("long")})


_MATCH = "w.investigation_id = q.investigation_id AND w.user_id IS NOT DISTINCT FROM q.user_id AND w.team_id IS NOT DISTINCT FROM q.team_id"
CAT.add(
    "watches_started",
    lambda c: watches.start(c, _asked(c)).select("investigation_id", "user_id", "team_id", "mode", "active", F.size("triggers").alias("triggers"), "last_status"),
    f"SELECT w.investigation_id, w.user_id, w.team_id, w.mode, w.active, len(w.triggers) AS triggers, w.last_status FROM watches w WHERE NOT EXISTS (SELECT 1 FROM ({_ASKED}) q WHERE {_MATCH}) UNION ALL SELECT q.investigation_id, q.user_id, q.team_id, q.mode, true, 6, i.status FROM ({_ASKED}) q JOIN investigations i ON i.id = q.investigation_id",
)
CAT.add("watches_stopped", lambda c: watches.stop(c, _asked(c)).select(F.col("id").alias("watch_id"), "active"), f"SELECT w.id AS watch_id, w.active AND NOT EXISTS (SELECT 1 FROM ({_ASKED}) q WHERE {_MATCH}) AS active FROM watches w")
CAT.add(
    "watched_list",
    lambda c: watches.of_user(c, 3),
    f"SELECT w.id AS watch_id, w.investigation_id, w.team_id, w.mode, s.status, s.overdue, CAST(s.next_due AS DATE) AS next_due, l.g AS last_notification FROM (SELECT * FROM watches WHERE active AND (user_id = 3 OR team_id IN (SELECT team_id FROM team_members WHERE user_id = 3))) w LEFT JOIN ({_SNAP}) s ON s.investigation_id = w.investigation_id LEFT JOIN (SELECT watch_id, arg_max(signature, (sent_at, signature)) AS g FROM watch_ledger GROUP BY 1) l ON l.watch_id = w.id",
)
_MENTION = """SELECT DISTINCT c.comment_id, u.id AS user_id FROM (SELECT id AS comment_id, author_id, lower(unnest(regexp_extract_all(body, '@([A-Za-z][A-Za-z0-9._-]{1,50})', 1))) AS token FROM comments) c
    JOIN users u ON c.token IN (lower(replace(u.name, ' ', '')), lower(split_part(u.name, ' ', 1)), lower(split_part(u.email, '@', 1))) WHERE u.id <> c.author_id"""
CAT.add(
    "comment_notifications",
    watches.comment_notifications,
    f"""SELECT DISTINCT w.id AS watch_id, c.id AS comment_id, coalesce(w.user_id, m.user_id) AS recipient_id, 'comment:' || c.id AS signature FROM comments c JOIN watches w ON w.investigation_id = c.investigation_id AND w.active AND list_contains({_WANTS.replace('triggers', 'w.triggers')}, 'comment') LEFT JOIN team_members m ON m.team_id = w.team_id
    WHERE coalesce(w.user_id, m.user_id) IS NOT NULL AND coalesce(w.user_id, m.user_id) <> c.author_id AND NOT EXISTS (SELECT 1 FROM watch_ledger l WHERE l.watch_id = w.id AND l.signature = 'comment:' || c.id) AND NOT EXISTS (SELECT 1 FROM ({_MENTION}) x WHERE x.comment_id = c.id AND x.user_id = coalesce(w.user_id, m.user_id))""",
)

# Outcomes
CAT.add(
    "outcome_candidates",
    outcomes.candidates,
    """SELECT i.id AS investigation_id, i.primary_sku AS sku, a.aid AS action_id, CAST(coalesce(n.first, i.opened_at) AS DATE) AS detected_on, CAST(a.at AS DATE) AS done_on FROM investigations i JOIN (SELECT investigation_id, arg_max(id, (completed_at, id)) AS aid, max(completed_at) AS at FROM actions WHERE status = 'completed' GROUP BY 1) a ON a.investigation_id = i.id
    LEFT JOIN (SELECT investigation_id, min(detected_at) AS first FROM anomalies WHERE investigation_id IS NOT NULL GROUP BY 1) n ON n.investigation_id = i.id WHERE i.status IN ('in_progress', 'resolved', 'closed') AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.investigation_id = i.id AND o.outcome_state IN ('observed_recovery', 'no_material_change') AND o.next_measurement_at IS NULL)""",
)
_AMT = "coalesce(CAST(s.total_amount AS DOUBLE), CAST(s.quantity AS DOUBLE) * coalesce(s.unit_price, 0))"


def _per(a: str, z: str) -> str:
    return f"round(CASE WHEN date_diff('day', {a}, {z}) > 0 THEN coalesce(sum(CASE WHEN s.date BETWEEN {a} AND {z} THEN {_AMT} END), 0) / greatest(1, date_diff('day', {a}, {z})) ELSE 0 END + CAST(1e-9 AS DOUBLE), 4)"


_OUT = f"""SELECT c.case_id, c.sku, c.detected_on, c.done_on, {_per('c.detected_on - 35', 'c.detected_on - 8')} AS baseline, {_per('c.detected_on - 7', 'c.done_on')} AS during,
    {_per('c.done_on', f'least({T}, c.done_on + 14)')} AS observed, greatest(1, date_diff('day', c.done_on, least({T}, c.done_on + 14))) AS elapsed, c.done_on + 14 > {T} AS monitoring FROM cases c LEFT JOIN sales s ON c.sku = s.sku AND s.date BETWEEN c.detected_on - 35 AND c.done_on + 14 GROUP BY c.case_id, c.sku, c.detected_on, c.done_on"""
CAT.add("outcome_windows", outcomes.windows, f"SELECT case_id, sku, detected_on, done_on, {r('baseline')} AS baseline, {r('during')} AS during, {r('observed')} AS observed, elapsed, monitoring FROM ({_OUT})")
_STATE = """CASE WHEN baseline <= 0 AND observed <= 0 THEN 'insufficient_evidence' WHEN elapsed < 3 AND monitoring THEN 'monitoring' WHEN baseline > 0 AND observed >= 0.9 * baseline THEN 'observed_recovery'
    WHEN during >= 0 AND observed > 1.1 * during AND observed > during THEN CASE WHEN monitoring THEN 'monitoring' ELSE 'partial_recovery' END WHEN monitoring THEN 'monitoring' ELSE 'no_material_change' END"""
_MEASURED = f"SELECT *, {_STATE} AS state, round(greatest(0, (observed - during) * elapsed) + 1e-9, 2) AS gain FROM ({_OUT})"
CAT.add("outcome_states", lambda c: outcomes.measurements(c).groupBy("outcome_state", "monitoring").agg(F.count("*").alias("cases")), f"SELECT state AS outcome_state, monitoring, count(*) AS cases FROM ({_MEASURED}) GROUP BY 1, 2")
CAT.add("outcome_measurements", lambda c: outcomes.measurements(c).select("case_id", "delta", "recovery_amount", "outcome_state"), f"SELECT case_id, {r('round(observed - baseline + 1e-9, 4)')} AS delta, {r('gain')} AS recovery_amount, state AS outcome_state FROM ({_MEASURED})")
CAT.add(
    "outcomes_upserted",
    lambda c: outcomes.upserted(c.table("case_outcomes"), outcomes.measurements(c), c.clock()).select("investigation_id", "outcome_state", "observed_recovery", "attribution_status", "evidence_strength", F.col("next_measurement_at").isNotNull().alias("again")),
    f"""SELECT coalesce(m.case_id, o.investigation_id) AS investigation_id, coalesce(m.state, o.outcome_state) AS outcome_state, {r("coalesce(o.observed_recovery, CASE WHEN m.state IN ('observed_recovery', 'partial_recovery') THEN m.gain END)")} AS observed_recovery,
      CASE WHEN m.case_id IS NULL THEN o.attribution_status WHEN m.state = 'observed_recovery' THEN 'estimated' ELSE 'not_attempted' END AS attribution_status, CASE WHEN m.case_id IS NULL THEN o.evidence_strength WHEN m.state = 'observed_recovery' THEN 'moderate' ELSE 'insufficient' END AS evidence_strength,
      CASE WHEN m.case_id IS NULL THEN o.next_measurement_at IS NOT NULL ELSE m.monitoring END AS again FROM case_outcomes o FULL JOIN ({_MEASURED}) m ON m.case_id = o.investigation_id""",
)


def _records(c):
    return c.table("investigations").where("id % 4 = 1").select(F.col("id").alias("investigation_id"), F.when(F.col("id") % 3 == 0, F.lit(77.5).cast("decimal(18,2)")).alias("revenue_recovered"), (F.col("id") % 8 == 1).alias("was_false_positive"))


_REC = "SELECT id AS investigation_id, CASE WHEN id % 3 = 0 THEN 77.5 END AS revenue_recovered, id % 8 = 1 AS was_false_positive FROM investigations WHERE id % 4 = 1"
CAT.add("outcomes_recorded", lambda c: outcomes.recorded(c.table("outcomes").select("investigation_id", "revenue_recovered", "was_false_positive", "outcome_type"), _records(c)), f"SELECT coalesce(o.investigation_id, q.investigation_id) AS investigation_id, {r('coalesce(q.revenue_recovered, o.revenue_recovered)')} AS revenue_recovered, coalesce(q.was_false_positive, o.was_false_positive) AS was_false_positive, o.outcome_type FROM outcomes o FULL JOIN ({_REC}) q ON q.investigation_id = o.investigation_id")
CAT.add("outcome_feedback", lambda c: outcomes.feedback(c.table("anomalies"), _records(c), c.clock()).select("id", "is_false_positive", F.col("dismissed_at").isNotNull().alias("dismissed")), f"SELECT a.id, a.is_false_positive OR q.investigation_id IS NOT NULL AS is_false_positive, a.dismissed_at IS NOT NULL OR q.investigation_id IS NOT NULL AS dismissed FROM anomalies a LEFT JOIN (SELECT * FROM ({_REC}) WHERE was_false_positive) q ON q.investigation_id = a.investigation_id")
CAT.add("outcome_net_impact", outcomes.net_impact, f"SELECT investigation_id, {r('revenue_recovered - coalesce(action_cost, 0)')} AS net_impact, {r('CASE WHEN revenue_at_risk > 0 THEN CAST(revenue_recovered AS DOUBLE) / CAST(revenue_at_risk AS DOUBLE) * 100 END')} AS recovery_rate FROM outcomes")
CAT.add(
    "bulk_action_result",
    lambda c: investigations.bulk_counts(investigations.bulk(c, c.table("users").select("id"), "dismiss", 5)[1]),
    "SELECT count(*) FILTER (WHERE id IN (SELECT id FROM investigations)) AS succeeded, count(*) FILTER (WHERE id NOT IN (SELECT id FROM investigations)) AS failed FROM users",
)
CAT.add("mention_resolution", investigations.mentions, _MENTION)

# Evidence
CAT.add("evidence_daily_sales", evidence.daily_sales, f"SELECT sku, '{{' || string_agg('\"' || date || '\":' || q, ',' ORDER BY date) || '}}' AS series, CAST(sum(q) AS BIGINT) AS units FROM (SELECT sku, date, CAST(sum(quantity) AS BIGINT) AS q FROM sales WHERE date >= {T} - 14 AND quantity > 0 GROUP BY sku, date) GROUP BY sku")
CAT.add(
    "evidence_last_day_z",
    evidence.last_day_z,
    f"SELECT l.sku, {r('l.q')} AS q, {r('(l.q - b.mean) / b.stddev')} AS z, CASE WHEN l.q > b.mean THEN 'supports' ELSE 'contradicts' END AS direction FROM (SELECT sku, arg_max(q, date) AS q FROM (SELECT sku, date, CAST(sum(quantity) AS DOUBLE) AS q FROM sales WHERE date >= {T} - 14 AND quantity > 0 GROUP BY 1, 2) GROUP BY 1) l JOIN (SELECT sku, avg(u) AS mean, stddev_pop(u) AS stddev FROM (SELECT sku, date, CAST(sum(quantity) AS DOUBLE) AS u FROM sales WHERE date >= {T} - 90 AND quantity > 0 GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 7 AND stddev_pop(u) >= 0.001) b ON l.sku = b.sku",
)
CAT.add("evidence_by_location", evidence.by_location, f"SELECT sku, location, {r('sum(quantity)')} AS units FROM sales WHERE date >= {T} - 30 AND sku IS NOT NULL GROUP BY 1, 2")
CAT.add("evidence_returns", evidence.returns, f"SELECT sku, {r('a')} AS returned, {r('g')} AS gross, {r('CASE WHEN g <> 0 THEN CAST(a AS DOUBLE) * 100 / CAST(g AS DOUBLE) END')} AS rate FROM (SELECT sku, coalesce(sum(abs(quantity)) FILTER (WHERE quantity < 0), 0) AS a, sum(quantity) FILTER (WHERE quantity > 0) AS g FROM sales WHERE date >= {T} - 30 GROUP BY 1)")
CAT.add(
    "evidence_cover_days",
    evidence.cover_days,
    f"SELECT sku, store_id, {r('on_hand_qty')} AS on_hand_qty, {r('reorder_point')} AS reorder_point, {r('c')} AS cover_days, c < 7 AS supports FROM (SELECT l.*, round(CAST(on_hand_qty AS DOUBLE) / (p.q / 30.0) + 1e-9, 1) AS c FROM (SELECT *, row_number() OVER (PARTITION BY sku, store_id ORDER BY as_of_date DESC NULLS FIRST, id) AS k FROM inventory) l JOIN (SELECT sku, CAST(sum(quantity) AS DOUBLE) AS q FROM part_sales WHERE date >= {T} - 30 AND quantity > 0 GROUP BY 1) p ON l.sku = p.sku WHERE k = 1)",
    **_PART,
)
_PO = "'{\"po_number\":\"' || po_number || '\",\"order_date\":\"' || order_date || '\",\"expected_date\":\"' || expected_date || '\"' || coalesce(',\"received_date\":\"' || received_date || '\"', '') || ',\"qty_ordered\":' || qty_ordered || coalesce(',\"qty_received\":' || qty_received, '')"
CAT.add(
    "evidence_last_orders",
    lambda c: evidence.last_orders(c).select("sku", "n", F.regexp_replace("orders", r',"unit_cost":[0-9.E]+\}', "").alias("orders")),
    f"SELECT sku, count(*) AS n, '[' || string_agg({_PO}, ',' ORDER BY k) || ']' AS orders FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY order_date DESC NULLS FIRST, po_number DESC, unit_cost DESC) AS k FROM purchase_orders) WHERE k <= 10 GROUP BY 1",
)
CAT.add("evidence_po_lead_time", evidence.lead_time, f"SELECT supplier, {r('avg(date_diff(' + chr(39) + 'day' + chr(39) + ', order_date, received_date))')} AS avg_days, count(*) AS orders FROM purchase_orders WHERE received_date IS NOT NULL GROUP BY 1")
CAT.add("evidence_price_range", evidence.price_range, f"SELECT sku, {r('min(unit_price)')} AS min_price, {r('avg(unit_price)')} AS avg_price, {r('max(unit_price)')} AS max_price, count(*) AS transactions FROM sales WHERE date >= {T} - 30 AND unit_price > 0 GROUP BY 1")
CAT.add("evidence_margin", evidence.margin, f"SELECT s.sku, {r('p.unit_cost')} AS unit_cost, {r('(a - p.unit_cost) * 100 / a')} AS margin_pct, a < p.unit_cost AS supports FROM (SELECT sku, avg(unit_price) AS a FROM sales WHERE date >= {T} - 30 AND unit_price > 0 GROUP BY 1) s JOIN products p ON s.sku = p.sku")
CAT.add("evidence_last_ingestion", evidence.last_ingestion, "SELECT '{' || string_agg('\"' || data_type || '\":\"' || strftime(last_at, '%Y-%m-%d %H:%M:%S') || '\"', ',' ORDER BY data_type) || '}' AS last_runs, count(*) AS data_types FROM (SELECT data_type, max(completed_at) AS last_at FROM runs WHERE status = 'completed' GROUP BY 1)")
CAT.add("evidence_sku_counts", evidence.sku_counts, "SELECT (SELECT count(DISTINCT sku) FROM sales) AS sold_skus, (SELECT count(*) FROM products) AS product_rows")
CAT.add("evidence_shown_values", evidence.shown_values, "SELECT id, CASE WHEN value_numeric IS NOT NULL THEN concat_ws(' ', format('{:.2f}', CAST(value_numeric AS DOUBLE)), unit) ELSE coalesce(value_text, '-') END AS shown FROM evidence")
CAT.add(
    "evidence_first_values",
    lambda c: evidence.first_values(c.table("evidence").where("id % 2 = 0").select("investigation_id", "anomaly_id", "label"), c.table("evidence").select("investigation_id", (F.col("anomaly_id") - F.col("anomaly_id") % 3).alias("anomaly_id"), "label")),
    "SELECT n.* FROM (SELECT investigation_id, anomaly_id - anomaly_id % 3 AS anomaly_id, label FROM evidence) n WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.id % 2 = 0 AND e.investigation_id = n.investigation_id AND e.anomaly_id = n.anomaly_id AND e.label = n.label)",
)
_IN = "(SELECT investigation_id, id AS anomaly_id, rule_type, sku, store_id FROM anomalies WHERE investigation_id IS NOT NULL)"
_NEWEST = "SELECT a.investigation_id, a.anomaly_id, a.sku, arg_max(struct_pack(q := l.on_hand_qty, p := l.reorder_point), (coalesce(l.as_of_date, DATE '9999-12-31'), -l.id)) AS l FROM (SELECT * FROM {a} WHERE rule_type IN ('stockout_risk', 'safety_stock_breach', 'dead_stock', 'phantom_inventory', 'multi_location_imbalance', 'inventory_shrinkage', 'reorder_point_staleness')) a JOIN inventory l ON l.sku = a.sku AND (a.store_id IS NULL OR a.store_id = l.store_id) GROUP BY 1, 2, 3".format(a=_IN)
_SOLD = f"SELECT sku, CAST(sum(quantity) AS DOUBLE) / 30.0 AS pace FROM part_sales WHERE date >= {T} - 30 AND quantity > 0 GROUP BY 1"
_14 = f"SELECT a.anomaly_id, a.investigation_id, CAST(sum(s.quantity) AS DOUBLE) AS units, count(DISTINCT s.date) AS days FROM (SELECT * FROM {_IN} WHERE rule_type IN ('sales_spike', 'sales_drop', 'demand_seasonality_breach')) a LEFT JOIN part_sales s ON s.sku = a.sku AND s.date >= {T} - 14 AND s.quantity > 0 AND (a.store_id IS NULL OR a.store_id = s.store_id) GROUP BY 1, 2"
_FIN = f"(SELECT * FROM {_IN} WHERE rule_type IN ('price_anomaly', 'margin_erosion', 'discount_signal', 'revenue_concentration_risk', 'slow_moving_capital'))"
_RET = f"SELECT a.investigation_id, a.anomaly_id, sum(abs(s.quantity)) FILTER (WHERE s.quantity < 0) AS b, sum(s.quantity) FILTER (WHERE s.quantity > 0) AS g FROM (SELECT * FROM {_IN} WHERE rule_type = 'return_rate_spike') a LEFT JOIN part_sales s ON s.sku = a.sku AND s.date >= {T} - 30 GROUP BY 1, 2"
_PUR = f"(SELECT * FROM {_IN} WHERE rule_type IN ('po_overdue', 'receiving_discrepancy', 'supplier_lead_time_drift', 'cost_spike'))"
_COLLECTED = f"""SELECT investigation_id, anomaly_id, 'Daily sales last 14 days' AS label, 'supports' AS direction, NULL::DOUBLE AS value FROM ({_14}) UNION ALL SELECT investigation_id, anomaly_id, 'Total units sold (last 14 days)', 'supports', coalesce(units, 0) FROM ({_14})
    UNION ALL SELECT investigation_id, anomaly_id, 'Units sold by location (last 30 days)', 'supports', NULL FROM {_IN} WHERE rule_type IN ('cannibalization_signal', 'channel_mix_shift', 'store_outlier')
    UNION ALL SELECT investigation_id, anomaly_id, 'Return units (last 30 days)', 'supports', coalesce(b, 0) FROM ({_RET}) UNION ALL SELECT investigation_id, anomaly_id, 'Return rate (returns / gross sales, last 30 days)', 'supports', round(CAST(coalesce(b, 0) AS DOUBLE) * 100 / CAST(g AS DOUBLE), 2) FROM ({_RET}) WHERE g > 0
    UNION ALL SELECT investigation_id, anomaly_id, 'Current on-hand quantity', 'supports', l.q FROM ({_NEWEST}) UNION ALL SELECT investigation_id, anomaly_id, 'Reorder point', 'neutral', l.p FROM ({_NEWEST}) WHERE l.p IS NOT NULL
    UNION ALL SELECT investigation_id, anomaly_id, 'Days of cover at current sales rate', CASE WHEN round(CAST(l.q AS DOUBLE) / pace + 1e-9, 1) < 7 THEN 'supports' ELSE 'neutral' END, round(CAST(l.q AS DOUBLE) / pace + 1e-9, 1) FROM ({_NEWEST}) n JOIN ({_SOLD}) p ON p.sku = n.sku
    UNION ALL SELECT investigation_id, anomaly_id, 'Recent purchase orders (last 10)', 'supports', NULL FROM {_PUR} WHERE sku IN (SELECT sku FROM purchase_orders)
    UNION ALL SELECT investigation_id, anomaly_id, 'Average supplier lead time (recent POs)', 'neutral', round(d, 1) FROM {_PUR} a JOIN (SELECT sku, avg(date_diff('day', order_date, received_date)) AS d FROM purchase_orders WHERE received_date IS NOT NULL GROUP BY 1) p ON p.sku = a.sku
    UNION ALL SELECT investigation_id, anomaly_id, 'Price range last 30 days (min / avg / max)', 'supports', NULL FROM {_FIN} WHERE sku IN (SELECT sku FROM part_sales WHERE date >= {T} - 30 AND unit_price > 0)
    UNION ALL SELECT investigation_id, anomaly_id, 'Unit cost (product master)', 'neutral', unit_cost FROM {_FIN} a JOIN part_products p ON p.sku = a.sku
    UNION ALL SELECT investigation_id, anomaly_id, 'Gross margin at average sale price', CASE WHEN m < 0 THEN 'supports' ELSE 'neutral' END, round(m, 2) FROM (SELECT a.investigation_id, a.anomaly_id, (s.v - p.unit_cost) * 100 / s.v AS m FROM {_FIN} a JOIN (SELECT sku, avg(unit_price) AS v FROM part_sales WHERE date >= {T} - 30 AND unit_price > 0 GROUP BY 1) s ON s.sku = a.sku JOIN part_products p ON p.sku = a.sku)
    UNION ALL SELECT investigation_id, anomaly_id, 'Last successful import per data type', 'supports', NULL FROM {_IN} WHERE rule_type IN ('import_frequency_gap', 'duplicate_transaction_ids', 'sku_master_drift', 'location_proliferation')
    UNION ALL SELECT investigation_id, anomaly_id, 'Distinct SKUs in sales vs product master', CASE WHEN (SELECT count(DISTINCT sku) FROM part_sales) > (SELECT count(*) FROM part_products) THEN 'supports' ELSE 'contradicts' END, NULL FROM {_IN} WHERE rule_type = 'sku_master_drift'"""
CAT.add("evidence_collected", lambda c: evidence.collected(c).select("investigation_id", "anomaly_id", "label", "direction", F.col("value_numeric").alias("value")), f"SELECT investigation_id, anomaly_id, label, direction, {r('value')} AS value FROM ({_COLLECTED})", **_PART)
CAT.add("evidence_strongest", evidence.strongest, "SELECT investigation_id, k, label, strength FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, id) AS k FROM evidence) WHERE k <= 4")
CAT.add("evidence_strength", metrics.evidence_label, "SELECT investigation_id, a AS strong, s AS supports, CASE WHEN a >= 3 OR (a >= 1 AND s >= 3) THEN 'Strong' WHEN a >= 1 OR s >= 2 THEN 'Moderate' ELSE 'Insufficient' END AS label FROM (SELECT investigation_id, count(*) FILTER (WHERE strength = 'strong' AND direction = 'supports') AS a, count(*) FILTER (WHERE direction = 'supports') AS s FROM evidence GROUP BY 1)")

# Rules and recovery
_PERF = f"SELECT rule_type, count(*) AS detections, count(dismissed_at) AS dismissed, count(*) FILTER (WHERE is_false_positive) AS false_positives, count(DISTINCT investigation_id) AS investigations, {r(pct('count(*) FILTER (WHERE is_false_positive)', 'count(*)'))} AS fp_rate FROM anomalies GROUP BY 1"
CAT.add("quality_rule_performance", metrics.rule_performance, _PERF)
CAT.add("quality_noisy_rules", lambda c: metrics.noisy_rules(c, 5, 10), f"SELECT rule_type, detections, fp_rate FROM ({_PERF}) WHERE detections >= 5 AND fp_rate >= 10")
CAT.add("quality_noisy_skus", lambda c: metrics.noisy_skus(c).drop("false_positives"), "SELECT sku, count(*) AS anomalies FROM anomalies WHERE sku IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_MONEY = f"count(*) AS outcomes, {r('coalesce(sum(revenue_at_risk), 0)')} AS at_risk, {r('coalesce(sum(revenue_recovered), 0)')} AS recovered"
CAT.add(
    "recovery_summary",
    metrics.recovery_summary,
    f"SELECT {r('coalesce(sum(revenue_at_risk), 0)')} AS at_risk, {r('coalesce(sum(revenue_recovered), 0)')} AS recovered, count(*) AS outcomes, count(*) FILTER (WHERE was_false_positive) AS false_positives, (SELECT count(*) FROM investigations WHERE status IN ('resolved', 'closed')) AS resolved, {r(pct('sum(revenue_recovered)', 'sum(revenue_at_risk)'))} AS recovery_rate FROM outcomes",
)
CAT.add("recovery_by_cause", metrics.recovery_by_cause, f"SELECT coalesce(c, 'uncategorised') AS cause, {_MONEY} FROM outcomes o LEFT JOIN (SELECT investigation_id, arg_max(rule_type, (detected_at, id)) AS c FROM anomalies WHERE investigation_id IS NOT NULL GROUP BY 1) a ON o.investigation_id = a.investigation_id GROUP BY 1")
CAT.add("recovery_by_action", metrics.recovery_by_action, f"SELECT coalesce(c, 'no_action') AS action_type, {_MONEY} FROM outcomes o LEFT JOIN (SELECT investigation_id, arg_max(action_type, (completed_at, id)) AS c FROM actions WHERE status = 'completed' GROUP BY 1) a ON o.investigation_id = a.investigation_id GROUP BY 1")
CAT.add("recovery_by_store", metrics.recovery_by_store, f"SELECT coalesce(s.name, 'Unassigned') AS store, count(*) AS outcomes, {r('coalesce(sum(o.revenue_at_risk), 0)')} AS at_risk, {r('coalesce(sum(o.revenue_recovered), 0)')} AS recovered FROM outcomes o JOIN investigations i ON o.investigation_id = i.id LEFT JOIN stores s ON i.primary_store_id = s.id GROUP BY 1")
CAT.add(
    "response_times",
    metrics.response_times,
    f"SELECT {r('round(avg(CASE WHEN a >= 0 THEN a END), 1)')} AS hours_to_action, {r('round(avg(CASE WHEN b >= 0 THEN b END), 1)')} AS hours_to_resolution FROM (SELECT {hours('f', 'opened_at')} AS a, {hours('resolved_at', 'opened_at')} AS b FROM investigations i LEFT JOIN (SELECT investigation_id, min(created_at) AS f FROM actions GROUP BY 1) x ON x.investigation_id = i.id)",
)
CAT.add(
    "primary_anomaly",
    metrics.primary_anomaly,
    f"SELECT printf('INV-%d-%06d', opened_year, investigation_id) AS display_id, rule_type, severity, id AS anomaly_id, CASE {PRI.format('p')} WHEN 4 THEN 2 WHEN 3 THEN 4 WHEN 2 THEN 8 ELSE 24 END::BIGINT AS sla_hours FROM (SELECT a.*, i.priority AS p, i.opened_year, row_number() OVER (PARTITION BY investigation_id ORDER BY {SEV} DESC, a.id) AS k FROM anomalies a JOIN (SELECT id AS iid, priority, year(opened_at) AS opened_year FROM investigations) i ON a.investigation_id = i.iid) WHERE k = 1",
)

# Widgets, lists, reports
CAT.add("sales_trend_30d", reports.sales_trend, f"SELECT d.day, {r('coalesce(v, 0)')} AS revenue, {r('coalesce(u, 0)')} AS units FROM (SELECT CAST(unnest(generate_series({T} - 30, {T}, INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN (SELECT date, sum(total_amount) AS v, sum(quantity) FILTER (WHERE quantity > 0) AS u FROM sales WHERE date >= {T} - 30 GROUP BY 1) s ON s.date = d.day")
CAT.add("top_skus", reports.top_skus, f"SELECT sku, {r('sum(total_amount)')} AS revenue FROM sales WHERE date >= {T} - 30 AND quantity > 0 GROUP BY 1 ORDER BY sum(total_amount) DESC, 1 LIMIT 10")
CAT.add("inventory_health_by_location", reports.inventory_health, "SELECT location AS place, count(*) FILTER (WHERE on_hand_qty <= 0) AS stockout, count(*) FILTER (WHERE on_hand_qty > 0 AND reorder_point IS NOT NULL AND on_hand_qty <= reorder_point) AS at_risk, count(*) FILTER (WHERE on_hand_qty > 0 AND (reorder_point IS NULL OR on_hand_qty > reorder_point)) AS healthy FROM inventory GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")
CAT.add(
    "po_fulfilment",
    reports.po_fulfilment,
    f"SELECT count(*) FILTER (WHERE received_date IS NULL) AS open, count(*) FILTER (WHERE received_date IS NULL AND expected_date < {T}) AS overdue, count(*) FILTER (WHERE received_date >= date_trunc('month', {T})) AS received_this_month, {r('round(100.0 * count(received_date) / count(*), 0)')} AS fulfilment_pct FROM purchase_orders",
)
CAT.add("anomaly_trend_30d", reports.anomaly_trend, "SELECT d.day, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN (SELECT CAST(detected_at AS DATE) AS day, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high FROM anomalies GROUP BY 1) a ON a.day = d.day")
CAT.add("anomalies_by_store", reports.anomalies_by_store, f"SELECT 'Store ' || a.store_id AS name, s.name AS store, count(*) AS anomalies FROM anomalies a LEFT JOIN stores s ON a.store_id = s.id WHERE a.store_id IS NOT NULL AND detected_at >= {NOW} - INTERVAL 30 DAY GROUP BY a.store_id, s.name")
CAT.add(
    "overview_counts",
    reports.overview,
    """SELECT *, CASE WHEN high_anomalies > 0 THEN high_anomalies || ' high severity' WHEN medium_anomalies > 0 THEN medium_anomalies || ' medium severity' WHEN open_anomalies > 0 THEN open_anomalies || ' low severity' ELSE 'No open anomalies' END AS banner,
      CASE WHEN high_anomalies > 0 THEN 'danger' WHEN medium_anomalies > 0 THEN 'warning' WHEN open_anomalies > 0 THEN 'info' ELSE 'success' END AS colour FROM (SELECT (SELECT count(*) FROM products) AS products, (SELECT count(*) FROM sales) AS sales, (SELECT count(*) FROM inventory) AS inventory,
      (SELECT count(*) FROM inventory WHERE reorder_point IS NOT NULL AND on_hand_qty <= reorder_point) AS low_stock, (SELECT count(*) FROM stores) AS stores, (SELECT count(*) FROM purchase_orders) AS purchase_orders, (SELECT count(*) FROM imports WHERE status IN ('uploaded', 'mapping_review', 'importing')) AS pending_imports,
      (SELECT count(*) FROM anomalies WHERE dismissed_at IS NULL) AS open_anomalies, (SELECT count(*) FROM anomalies WHERE dismissed_at IS NULL AND severity = 'high') AS high_anomalies, (SELECT count(*) FROM anomalies WHERE dismissed_at IS NULL AND severity = 'medium') AS medium_anomalies)""",
)
CAT.add(
    "investigation_overview",
    reports.investigation_overview,
    f"""SELECT count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE {OPEN} AND priority = 'critical') AS critical, count(*) FILTER (WHERE {OPEN} AND priority = 'high') AS high,
      count(*) FILTER (WHERE status = 'resolved' AND resolved_at >= {NOW} - INTERVAL 7 DAY) AS recently_resolved, {r(f'round(avg({hours(NOW, "opened_at")}) FILTER (WHERE {OPEN}), 1)')} AS avg_open_hours FROM investigations""",
)
_WAS = f"opened_at >= {NOW} - INTERVAL 14 DAY AND opened_at < {NOW} - INTERVAL 7 DAY"
_HOT = "priority IN ('high', 'critical')"
CAT.add(
    "kpi_trends",
    lambda c: reports.kpi_trends(c, waiting=("pending", "assigned")),
    f"""SELECT kpi, {r('v')} AS value, {r('p')} AS previous, {r('CASE WHEN p <> 0 THEN round(abs(v - p) / abs(p) * 100 + 1e-9, 1) END')} AS change_pct, CASE WHEN p = 0 OR p IS NULL OR round(abs(v - p) / abs(p) * 100 + 1e-9, 1) = 0 THEN 'flat' WHEN v > p THEN 'up' ELSE 'down' END AS direction FROM (
      SELECT 'revenue_at_risk' AS kpi, CAST(coalesce(sum(revenue_at_risk) FILTER (WHERE {OPEN}), 0) AS DOUBLE) AS v, CAST(coalesce(sum(revenue_at_risk) FILTER (WHERE {_WAS}), 0) AS DOUBLE) AS p FROM investigations
      UNION ALL SELECT 'open_investigations', count(*) FILTER (WHERE {OPEN}), count(*) FILTER (WHERE {_WAS}) FROM investigations UNION ALL SELECT 'high_priority', count(*) FILTER (WHERE {OPEN} AND {_HOT}), count(*) FILTER (WHERE {_WAS} AND {_HOT}) FROM investigations
      UNION ALL SELECT 'overdue_actions', count(*), NULL FROM actions WHERE status IN ('pending', 'assigned') AND created_at < {NOW} - INTERVAL 48 HOUR AND investigation_id IN (SELECT id FROM investigations WHERE {OPEN})
      UNION ALL SELECT 'recovered_mtd', coalesce(sum(revenue_recovered) FILTER (WHERE recorded_at >= DATE '2024-01-01'), 0), coalesce(sum(revenue_recovered) FILTER (WHERE recorded_at >= DATE '2023-12-01' AND recorded_at < DATE '2024-01-01'), 0) FROM outcomes)""",
)
CAT.add("top_drivers", reports.top_drivers, f"SELECT rule_type, n AS anomalies, {r(pct('n', 'sum(n) OVER ()'))} AS share FROM (SELECT rule_type, count(*) AS n FROM anomalies WHERE dismissed_at IS NULL GROUP BY 1 ORDER BY n DESC, rule_type LIMIT 5)")
_TOP = "SELECT rule_type, count(*) AS anomalies FROM anomalies WHERE dismissed_at IS NULL AND {} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
CAT.add("insights", reports.insights, f"SELECT 'recurring' AS insight, * FROM ({_TOP.format('ai_is_recurring')}) UNION ALL SELECT 'this_month', * FROM ({_TOP.format('CAST(detected_at AS DATE) >= DATE ' + chr(39) + '2024-01-01' + chr(39))})")
CAT.add("pending_actions", lambda c: reports.pending_actions(c, ("pending", "assigned")), f"SELECT id, investigation_id, title, status FROM actions WHERE status IN ('pending', 'assigned') AND investigation_id IN (SELECT id FROM investigations WHERE {OPEN}) ORDER BY created_at, id LIMIT 6")
CAT.add("sla_compliance", reports.sla_compliance, f"SELECT CASE WHEN h < 0 THEN 'overdue' WHEN h < 24 THEN 'at_risk' ELSE 'on_track' END AS sla, count(*) AS actions FROM (SELECT {hours('due_at', NOW)} AS h FROM actions WHERE {_UNDONE} AND due_at IS NOT NULL) GROUP BY 1")
_WEEK = "CAST(due_at AS DATE) BETWEEN DATE '2024-01-31' AND DATE '2024-02-04'"
CAT.add(
    "action_tab_counts",
    reports.action_counts,
    f"""SELECT count(*) FILTER (WHERE {_UNDONE}) AS "all", count(*) FILTER (WHERE {_UNDONE} AND due_at < {NOW}) AS overdue, count(*) FILTER (WHERE {_UNDONE} AND CAST(due_at AS DATE) = DATE '2024-01-31') AS due_today, count(*) FILTER (WHERE {_UNDONE} AND {_WEEK}) AS due_week, count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
      count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'completed' AND date_trunc('month', completed_at) = DATE '2024-01-01') AS completed_this_month FROM actions""",
)
CAT.add("actions_by_type", reports.actions_by_type, f"SELECT action_type, count(*) AS actions FROM actions WHERE {_UNDONE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
CAT.add("upcoming_deadlines", reports.upcoming_deadlines, f"SELECT id, action_type, priority FROM actions WHERE {_UNDONE} AND due_at <= {NOW} + INTERVAL 3 DAY ORDER BY due_at, id LIMIT 8")
CAT.add("action_list_page", lambda c: reports.action_page(c, "back 5", 2, 10), f"SELECT a.id, a.title, a.status, a.priority FROM actions a JOIN (SELECT id AS iid, title AS t FROM investigations) i ON a.investigation_id = i.iid WHERE {ACTIVE.replace('status', 'a.status')} AND (a.title ILIKE '%back 5%' OR coalesce(a.description ILIKE '%back 5%', false) OR i.t ILIKE '%back 5%') ORDER BY {PRI.format('a.priority')} DESC, a.due_at, a.id LIMIT 10 OFFSET 10")
CAT.add("investigation_list_page", lambda c: reports.investigation_page(c, "open", "high_critical", "sales_drop", "investigation"), f"SELECT id, title, status, priority, {r('revenue_at_risk')} AS revenue_at_risk FROM investigations i WHERE {OPEN} AND priority IN ('high', 'critical') AND title ILIKE '%investigation%' AND EXISTS (SELECT 1 FROM anomalies a WHERE a.investigation_id = i.id AND a.rule_type = 'sales_drop') ORDER BY i.revenue_at_risk DESC NULLS FIRST, id LIMIT 25")
CAT.add("anomaly_list", reports.anomaly_list, f"SELECT id, rule_type, severity, sku FROM anomalies WHERE dismissed_at IS NULL ORDER BY {SEV} DESC, detected_at DESC, id LIMIT 50")
CAT.add("anomaly_digest", lambda c: reports.digest(c, ("high", "medium")), "SELECT id, rule_type, severity, sku FROM anomalies WHERE dismissed_at IS NULL AND notified_at IS NULL AND severity IN ('high', 'medium')")
CAT.add("report_investigations_by_status", lambda c: reports.count_by(c.table("investigations"), "status"), "SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM investigations GROUP BY 1")
CAT.add("report_investigations_by_priority", lambda c: reports.count_by(c.table("investigations"), "priority"), "SELECT coalesce(priority, 'unknown') AS priority, count(*) AS n FROM investigations GROUP BY 1")
CAT.add("report_anomalies_by_severity", lambda c: reports.count_by(c.table("anomalies"), "severity"), "SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM anomalies GROUP BY 1")
CAT.add("report_anomalies_by_rule", reports.report_by_rule, f"SELECT rule_type, count(*) AS detections, count(dismissed_at) AS dismissed, count(*) FILTER (WHERE is_false_positive) AS false_positives, {r('sum(revenue_impact)')} AS impact FROM anomalies GROUP BY 1")
CAT.add("financial_breakdown_revenue_at_risk", reports.financial_breakdown, f"SELECT id, status, {r('revenue_at_risk')} AS revenue_at_risk, {r(pct('v', 't'))} AS share FROM (SELECT *, revenue_at_risk AS v, sum(revenue_at_risk) OVER () AS t FROM investigations WHERE {OPEN} AND revenue_at_risk > 0) ORDER BY v DESC, id LIMIT 200")
CAT.add("store_counts", reports.store_counts, "SELECT s.name, coalesce(a.n, 0) AS sales, coalesce(i.n, 0) AS levels FROM stores s LEFT JOIN (SELECT store_id, count(*) AS n FROM sales GROUP BY 1) a ON a.store_id = s.id LEFT JOIN (SELECT store_id, count(*) AS n FROM inventory GROUP BY 1) i ON i.store_id = s.id")
CAT.add("supplier_counts", reports.supplier_counts, f"SELECT s.name, coalesce(n, 0) AS orders, {r('coalesce(u, 0)')} AS units FROM suppliers s LEFT JOIN (SELECT supplier, count(*) AS n, sum(qty_ordered) AS u FROM purchase_orders GROUP BY 1) p ON p.supplier = s.name")
CAT.add("sales_list_filtered", lambda c: reports.sales_list(c, "NATION_7", dt.date(2001, 7, 1), dt.date(2001, 8, 1)), f"SELECT date, sku, {r('quantity')} AS quantity, {r('total_amount')} AS total_amount FROM sales WHERE location = 'NATION_7' AND date BETWEEN DATE '2001-07-01' AND DATE '2001-08-01'")
CAT.add("badge_counts", lambda c: reports.badges(c, 3), f"SELECT (SELECT count(*) FROM investigations WHERE {OPEN} AND priority IN ('high', 'critical')) AS urgent, (SELECT count(*) FROM suppressions WHERE active) AS suppressions, (SELECT count(*) FROM watches WHERE user_id = 3) AS watches")
CAT.add("status_breakdown", reports.status_breakdown, f"SELECT status, n, {r('v')} AS at_risk, {r(pct('n', 't'))} AS share FROM (SELECT status, count(*) AS n, coalesce(sum(revenue_at_risk), 0) AS v, sum(count(*)) OVER () AS t FROM investigations GROUP BY 1)")
CAT.add(
    "money_series_30d",
    reports.money_series,
    f"SELECT d.day, {r('coalesce(a, 0)')} AS at_risk, {r('coalesce(b, 0)')} AS recovered FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN (SELECT CAST(opened_at AS DATE) AS day, sum(revenue_at_risk) AS a FROM investigations GROUP BY 1) i ON i.day = d.day LEFT JOIN (SELECT CAST(recorded_at AS DATE) AS day, sum(revenue_recovered) AS b FROM outcomes GROUP BY 1) o ON o.day = d.day",
)
CAT.add("top_alert_store", reports.top_alert_store, f"SELECT store_id, count(*) AS anomalies FROM anomalies WHERE dismissed_at IS NULL AND detected_at >= {NOW} - INTERVAL 14 DAY AND store_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
CAT.add("recent_urgent_investigations", reports.recent_urgent, f"SELECT id, priority, status FROM investigations WHERE {OPEN} AND priority IN ('high', 'critical') ORDER BY opened_at DESC, id LIMIT 6")
CAT.add("anomaly_dossier", reports.dossier, "SELECT a.id, a.rule_type, i.title, i.status, coalesce(e.n, 0) AS pieces, o.outcome_type FROM anomalies a LEFT JOIN investigations i ON a.investigation_id = i.id LEFT JOIN (SELECT investigation_id, count(*) AS n FROM evidence GROUP BY 1) e ON e.investigation_id = a.investigation_id LEFT JOIN outcomes o ON o.investigation_id = a.investigation_id")
CAT.add("related_anomalies", reports.related_anomalies, "SELECT id, related_id, r FROM (SELECT a.id, b.id AS related_id, row_number() OVER (PARTITION BY a.id ORDER BY b.detected_at DESC, b.id) AS r FROM (SELECT * FROM anomalies WHERE dismissed_at IS NULL AND severity = 'high') a JOIN anomalies b ON a.sku = b.sku AND a.id <> b.id) WHERE r <= 5")
CAT.add("financial_breakdown_recovered", reports.recovered_this_month, f"SELECT investigation_id, outcome_type, {r('revenue_recovered')} AS revenue_recovered FROM outcomes WHERE CAST(recorded_at AS DATE) >= DATE '2024-01-01' AND revenue_recovered > 0 ORDER BY outcomes.revenue_recovered DESC, investigation_id LIMIT 200")

# Periods and reports
_TODAY = "DATE '2024-01-31'"
_FIRST = "(SELECT min(d) FROM (SELECT CAST(min(detected_at) AS DATE) AS d FROM anomalies UNION ALL SELECT CAST(min(opened_at) AS DATE) FROM investigations UNION ALL SELECT CAST(min(recorded_at) AS DATE) FROM outcomes UNION ALL SELECT min(date) FROM sales))"
_PERIOD = (dt.date(2024, 1, 5), dt.date(2024, 1, 25))


def _in(column: str) -> str:
    return f"CAST({column} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"


def _requests(c):
    rows = [(None, None), (dt.date(2024, 1, 3), None), (dt.date(1990, 1, 1), dt.date(2030, 1, 1)), (dt.date(2024, 2, 9), dt.date(2024, 3, 1)), (dt.date(2024, 1, 9), dt.date(2024, 1, 5))]
    return c.table("sales").sparkSession.createDataFrame(rows, "first date, last date")


CAT.add("report_range", reports.available_range, f"SELECT {_FIRST} AS first, {_TODAY} AS last")
CAT.add(
    "report_range_clamped",
    lambda c: reports.clamped_range(c, _requests(c)),
    f"SELECT CASE WHEN f > l THEN a ELSE f END AS first, CASE WHEN f > l THEN {_TODAY} ELSE l END AS last FROM (SELECT a, greatest(coalesce(f, a), a) AS f, least(coalesce(l, {_TODAY}), {_TODAY}) AS l FROM (SELECT {_FIRST} AS a) x, (VALUES (NULL, NULL), (DATE '2024-01-03', NULL), (DATE '1990-01-01', DATE '2030-01-01'), (DATE '2024-02-09', DATE '2024-03-01'), (DATE '2024-01-09', DATE '2024-01-05')) AS q(f, l))",
)
CAT.add("report_presets", reports.presets, f"SELECT preset, greatest(d, {_FIRST}) AS \"from\", {_TODAY} AS \"to\" FROM (VALUES ('7d', DATE '2024-01-24'), ('30d', DATE '2024-01-01'), ('90d', DATE '2023-11-02'), ('mtd', DATE '2024-01-01'), ('ytd', DATE '2024-01-01'), ('all', DATE '1900-01-01')) AS p(preset, d)")
CAT.add(
    "report_period_times",
    lambda c: reports.period_times(c, *_PERIOD),
    f"SELECT (SELECT {r('round(avg(CASE WHEN h >= 0 THEN h END), 1)')} FROM (SELECT {hours('f', 'opened_at')} AS h FROM investigations i JOIN (SELECT investigation_id, min(created_at) AS f FROM actions WHERE {_in('created_at')} GROUP BY 1) a ON a.investigation_id = i.id)) AS hours_to_action, (SELECT {r('round(avg(CASE WHEN h >= 0 THEN h END), 1)')} FROM (SELECT {hours('resolved_at', 'opened_at')} AS h FROM investigations WHERE {_in('resolved_at')})) AS hours_to_resolution",
)
CAT.add(
    "report_recovery",
    lambda c: reports.recovery_report(c, *_PERIOD),
    f"SELECT {r('coalesce(sum(revenue_at_risk), 0)')} AS at_risk, {r('coalesce(sum(revenue_recovered), 0)')} AS recovered, {r(pct('sum(revenue_recovered)', 'sum(revenue_at_risk)'))} AS recovery_rate, {r('coalesce(sum(revenue_recovered), 0) - coalesce(sum(action_cost), 0)')} AS net_impact, (SELECT count(*) FROM investigations WHERE status IN ('resolved', 'closed') AND {_in('resolved_at')}) AS resolved, count(*) FILTER (WHERE was_false_positive) AS false_positives FROM outcomes WHERE {_in('recorded_at')}",
)
CAT.add(
    "report_investigations",
    lambda c: reports.investigation_report(c, *_PERIOD),
    f"SELECT count(*) AS opened, count(*) FILTER (WHERE {OPEN}) AS open, count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS resolved, {r('round(avg(CASE WHEN ' + hours('resolved_at', 'opened_at') + ' >= 0 THEN ' + hours('resolved_at', 'opened_at') + ' END), 1)')} AS hours_to_resolution, {r('coalesce(sum(revenue_at_risk), 0)')} AS at_risk, {r(pct(chr(40) + 'count(*) FILTER (WHERE status IN (' + chr(39) + 'resolved' + chr(39) + ', ' + chr(39) + 'closed' + chr(39) + ')))', 'count(*)'))} AS resolution_rate FROM investigations WHERE {_in('opened_at')}",
)
CAT.add(
    "report_anomalies",
    lambda c: reports.anomaly_report(c, *_PERIOD),
    f"SELECT count(*) AS detected, count(*) FILTER (WHERE severity = 'high') AS high, count(investigation_id) AS correlated, count(dismissed_at) AS dismissed, count(*) FILTER (WHERE is_false_positive) AS false_positives, {r(pct('count(*) FILTER (WHERE is_false_positive)', 'count(*)'))} AS false_positive_rate FROM anomalies WHERE {_in('detected_at')}",
)
_MONTH = "CAST(recorded_at AS DATE) >= DATE '2024-01-01' AND revenue_recovered > 0"
_CARDS = {
    "revenue_at_risk": ("coalesce(sum(revenue_at_risk), 0)", "count(*)", f"investigations WHERE {OPEN}"),
    "recovered_mtd": ("coalesce(sum(revenue_recovered), 0)", "count(*)", f"outcomes WHERE {_MONTH}"),
    "outcome_at_risk": ("coalesce(sum(revenue_at_risk), 0)", "count(revenue_at_risk)", "outcomes"),
    "observed_recovery": ("coalesce(sum(revenue_recovered), 0)", "count(*) FILTER (WHERE revenue_recovered > 0)", "outcomes"),
    "recovery_rate": (pct("sum(revenue_recovered)", "sum(revenue_at_risk)"), "count(revenue_at_risk)", "outcomes"),
    "false_positives": ("count(*)", "count(*)", "outcomes WHERE was_false_positive"),
}
CAT.add("financial_breakdown_headlines", reports.breakdown_headlines, " UNION ALL ".join(f"SELECT '{k}' AS metric, {r(v)} AS value, {n} AS n FROM {t}" for k, (v, n, t) in _CARDS.items()))
for _metric, _where, _order in (("outcome_at_risk", "revenue_at_risk IS NOT NULL", "o.revenue_at_risk"), ("observed_recovery", "revenue_recovered > 0", "o.revenue_recovered"), ("recovery_rate", "revenue_at_risk IS NOT NULL", "o.revenue_recovered"), ("false_positives", "was_false_positive", "o.recorded_at")):
    CAT.add(
        f"financial_breakdown_{_metric}",
        lambda c, m=_metric: reports.outcome_breakdown(c, m),
        f"SELECT o.investigation_id, coalesce(i.title, 'Investigation #' || o.investigation_id) AS title, i.primary_sku AS sku, o.outcome_type, {r('o.revenue_at_risk')} AS revenue_at_risk, {r('o.revenue_recovered')} AS revenue_recovered FROM (SELECT * FROM outcomes o WHERE {_where} ORDER BY {_order} DESC NULLS FIRST, investigation_id LIMIT 200) o LEFT JOIN (SELECT id, title, primary_sku FROM investigations) i ON i.id = o.investigation_id",
    )
_SLA = f"CASE WHEN NOT {_UNDONE.replace('status', 'a.status')} OR a.due_at IS NULL THEN 'none' WHEN {hours('a.due_at', NOW)} < 0 THEN 'overdue' WHEN {hours('a.due_at', NOW)} < 4 THEN 'critical' WHEN {hours('a.due_at', NOW)} < 24 THEN 'warning' ELSE 'ok' END"
_ACT = f"SELECT a.id, a.title, a.action_type, a.status, a.priority, {_SLA} AS sla FROM actions a JOIN (SELECT id AS iid, title AS t FROM investigations) i ON a.investigation_id = i.iid"
for _tab, _where in {
    "all": "true", "overdue": f"{_UNDONE} AND due_at < {NOW}", "due_today": f"{_UNDONE} AND CAST(due_at AS DATE) = {_TODAY}", "due_week": f"{_UNDONE} AND CAST(due_at AS DATE) BETWEEN {_TODAY} AND DATE '2024-02-04'", "in_progress": "status = 'in_progress'", "completed": "status = 'completed'",
}.items():
    CAT.add(f"action_tab_{_tab}", lambda c, t=_tab: reports.action_rows(c, t), f"{_ACT} WHERE {_where.replace('status', 'a.status').replace('due_at', 'a.due_at')} ORDER BY a.due_at NULLS LAST, a.id LIMIT 25")
CAT.add("action_list_filtered", lambda c: reports.action_rows(c, "all", "call back 5", None, 5, None, "priority", False), f"{_ACT} WHERE (a.title ILIKE '%call back 5%' OR a.description ILIKE '%call back 5%' OR i.t ILIKE '%call back 5%') AND a.assignee_id = 5 ORDER BY {PRI.format('a.priority')} DESC, a.id LIMIT 25")
CAT.add("action_list_latest", lambda c: reports.action_rows(c, "all", "action", "reorder", None, "low", "due_at", True), f"{_ACT} WHERE a.title ILIKE '%action%' AND a.action_type = 'reorder' AND a.priority = 'low' ORDER BY a.due_at DESC NULLS FIRST, a.id LIMIT 25")
CAT.add("anomaly_page", lambda c: reports.anomaly_page(c, rule="sales_drop", sku="1"), "SELECT id, rule_type, severity, sku FROM anomalies WHERE dismissed_at IS NULL AND rule_type = 'sales_drop' AND sku ILIKE '%1%' ORDER BY severity, detected_at DESC, id LIMIT 25")
CAT.add("audit_list", lambda c: reports.audit_list(c, "status_changed", None, "30d"), f"SELECT a.id, a.event_type, coalesce(u.name, 'System') AS actor, CASE WHEN a.new_value ->> '$.source' = 'email' THEN 'Email' ELSE '-' END AS channel, a.investigation_id FROM audit a LEFT JOIN (SELECT id AS uid, name FROM users) u ON u.uid = a.user_id WHERE a.event_type = 'status_changed' AND a.created_at >= {NOW} - INTERVAL 30 DAY")
CAT.add(
    "audit_appended",
    lambda c: reports.audit_appended(c.table("audit"), c.table("actions").select("tenant_id", "investigation_id", F.lit("action_seen").alias("event_type")), c.clock()).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first")).select("event_type", "n", "ids", F.when(F.col("event_type") == "action_seen", F.col("first")).alias("first")),
    "SELECT event_type, count(*) AS n, count(*) AS ids, CAST(NULL AS BIGINT) AS first FROM audit GROUP BY 1 UNION ALL SELECT 'action_seen', count(*), count(*), (SELECT max(id) + 1 FROM audit) FROM actions",
)
_SHOWN = "CASE WHEN value_numeric IS NOT NULL THEN concat_ws(' ', format('{:.2f}', CAST(value_numeric AS DOUBLE)), unit) ELSE coalesce(value_text, '-') END"
CAT.add(
    "investigation_detail",
    reports.investigation_detail,
    f"""SELECT i.id AS investigation_id, coalesce(e.t, 'No supporting evidence collected yet.') AS evidence_text, coalesce(f.t, 'Multiple correlated signals detected across the investigation window.') AS factors_text,
      CASE WHEN coalesce(i.revenue_at_risk, 0) <> 0 THEN 'Estimated revenue at risk: $' || format('{{:,.2f}}', CAST(i.revenue_at_risk AS DOUBLE)) || '.' ELSE 'Revenue impact not yet quantified.' END AS impact_text,
      CASE i.ai_confidence WHEN 'established' THEN 'CAUSE ESTABLISHED' WHEN 'probable' THEN 'CAUSE PROBABLE' WHEN 'suspected' THEN 'UNDER INVESTIGATION' ELSE 'PENDING ANALYSIS' END AS cause_label, coalesce(x.done, x.any) AS last_action
    FROM investigations i LEFT JOIN (SELECT investigation_id, string_agg(label || ': ' || {_SHOWN}, ', ' ORDER BY id) AS t FROM evidence WHERE direction = 'supports' GROUP BY 1) e ON e.investigation_id = i.id
    LEFT JOIN (SELECT investigation_id, string_agg(d, '; ' ORDER BY k) AS t FROM (SELECT investigation_id, d, row_number() OVER (PARTITION BY investigation_id ORDER BY min(src), min(id)) AS k FROM (SELECT investigation_id, 0 AS src, id, description AS d FROM anomalies WHERE description <> '' AND investigation_id IS NOT NULL UNION ALL SELECT investigation_id, 1, id, label FROM evidence WHERE direction = 'context') GROUP BY investigation_id, d) WHERE k <= 5 GROUP BY 1) f ON f.investigation_id = i.id
    LEFT JOIN (SELECT investigation_id, arg_max(title, id) FILTER (WHERE status = 'completed') AS done, arg_max(title, id) AS any FROM actions GROUP BY 1) x ON x.investigation_id = i.id""",
)
CAT.add(
    "detection_rows",
    reports.detection_rows,
    f"""WITH e AS (SELECT investigation_id, k, label, {_SHOWN} AS value FROM (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY id) AS k FROM evidence) WHERE k <= 10),
    p AS (SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY investigation_id ORDER BY {SEV} DESC, a.id) AS k FROM anomalies a JOIN (SELECT id AS iid FROM investigations) i ON a.investigation_id = i.iid) WHERE k = 1 AND investigation_id NOT IN (SELECT investigation_id FROM e))
    SELECT investigation_id, k, label, value FROM e UNION ALL SELECT investigation_id, 1, 'Units Sold', context ->> '$.units_sold' FROM p UNION ALL SELECT investigation_id, 2, 'Window Days', context ->> '$.window_days' FROM p""",
)
_WORDS = "array_to_string(list_transform(string_split({}, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
CAT.add(
    "export_anomalies",
    reports.export_anomalies,
    f"""SELECT id AS "ID", severity AS "Severity", {_LABEL.format('rule_type')} AS "Rule", coalesce(sku, '') AS "SKU", coalesce(description, '') AS "Description", coalesce(investigation_status, 'not_started') AS "Investigation Status", coalesce(action_notes, '') AS "Action Notes", coalesce(resolution_notes, '') AS "Resolution Notes",
      coalesce(strftime(detected_at, '%Y-%m-%d %H:%M'), '') AS "Detected At", coalesce(strftime(resolved_at, '%Y-%m-%d %H:%M'), '') AS "Resolved At" FROM anomalies""",
)
CAT.add("export_investigations", reports.export_investigations, f"""SELECT i.id AS "ID", i.title AS "Title", i.status AS "Status", i.priority AS "Priority", i.primary_sku AS "SKU", t.name AS "Team", {r('i.revenue_at_risk')} AS "Revenue at Risk", {r('o.revenue_recovered')} AS "Observed Recovery", strftime(i.opened_at, '%Y-%m-%d %H:%M:%S') AS "Opened At" FROM investigations i LEFT JOIN teams t ON t.id = i.assigned_team_id LEFT JOIN outcomes o ON o.investigation_id = i.id""")
CAT.add(
    "export_actions",
    reports.export_actions,
    f"""SELECT a.id AS "ID", a.title AS "Title", {_WORDS.format('a.action_type')} AS "Type", coalesce(i.title, '—') AS "Investigation", {_WORDS.format('a.priority')} AS "Priority", {_WORDS.format('a.status')} AS "Status", coalesce(u.name, t.name, 'Unassigned') AS "Assigned To", coalesce(strftime(a.due_at, '%Y-%m-%d %H:%M:%S'), '—') AS "Due At", {_SLA} AS "SLA Status"
      FROM actions a LEFT JOIN investigations i ON i.id = a.investigation_id LEFT JOIN users u ON u.id = a.assignee_id LEFT JOIN teams t ON t.id = a.assigned_team_id""",
)
CAT.add("notified_users", lambda c: reports.notified(c.table("watches").select(F.when(F.col("id") % 5 == 0, 0).otherwise(F.col("user_id")).alias("user_id"))), "SELECT DISTINCT user_id FROM watches WHERE user_id IS NOT NULL AND user_id <> 0 AND id % 5 <> 0")
CAT.add("record_keys", lambda c: reports.record_key(c.table("audit").select(F.when(F.col("id") % 3 == 0, F.concat(F.lit('{"id":'), F.col("id"), F.lit("}"))).when(F.col("id") % 3 == 1, F.concat(F.lit('{"data":{"id":'), F.col("id"), F.lit("}}"))).otherwise(F.col("id").cast("string")).alias("key"))).select("record_id"), "SELECT CAST(id AS VARCHAR) AS record_id FROM audit")
CAT.add("short_money", lambda c: c.table("investigations").select("id", short_money(F.coalesce(F.col("revenue_at_risk"), F.lit(0)).cast("double") * F.when(F.col("id") % 3 == 0, 1000).otherwise(1)).alias("shown")), "SELECT id, CASE WHEN v >= 1e6 THEN printf('$%.2fM', v / 1e6) WHEN v >= 1e3 THEN printf('$%.1fK', v / 1e3) ELSE printf('$%.0f', v) END AS shown FROM (SELECT id, CAST(coalesce(revenue_at_risk, 0) AS DOUBLE) * CASE WHEN id % 3 = 0 THEN 1000 ELSE 1 END AS v FROM investigations)")
CAT.add(
    "narration_replies",
    lambda c: investigations.parse_narration(c.table("investigations").select("id", F.concat(F.lit('```json\n{"summary":"s'), F.col("id"), F.lit('","confidence":"'), F.expr("element_at(array('established', 'probable', 'suspected', 'Probable', 'high', 'unknown'), cast(id % 6 + 1 AS int))"), F.lit('"}\n```')).alias("reply"))).select("id", "summary", "confidence"),
    "SELECT id, 's' || id AS summary, CASE id % 6 WHEN 0 THEN 'established' WHEN 1 THEN 'probable' WHEN 2 THEN 'suspected' ELSE 'unknown' END AS confidence FROM investigations",
)
CAT.add("investigation_list_by_priority", lambda c: reports.investigation_page(c, None, None, None, "about", 6, "priority"), f"SELECT id, title, status, priority, {r('revenue_at_risk')} AS revenue_at_risk FROM investigations i WHERE (title ILIKE '%about%' OR primary_sku ILIKE '%about%' OR description ILIKE '%about%') AND primary_store_id = 6 ORDER BY {PRI.format('priority')} DESC, id LIMIT 25")
CAT.add("order_list", lambda c: reports.order_list(c, "Supplier#000000007", dt.date(1999, 1, 1), dt.date(2000, 12, 31)), f"SELECT po_number, supplier, sku, order_date, {r('qty_ordered')} AS qty_ordered, {r('qty_received')} AS qty_received FROM purchase_orders WHERE supplier = 'Supplier#000000007' AND order_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'")
CAT.add("return_list", lambda c: reports.return_list(c, "NATION_7", dt.date(2001, 1, 1), None), f"SELECT date, sku, location, {r('quantity')} AS quantity, {r('value')} AS value FROM returns WHERE location = 'NATION_7' AND date >= DATE '2001-01-01'")
CAT.add("inventory_list_low", lambda c: reports.inventory_list(c, "L7", True), f"SELECT sku, location, {r('on_hand_qty')} AS on_hand_qty, {r('reorder_point')} AS reorder_point, as_of_date FROM inventory WHERE location = 'L7' AND reorder_point > 0 AND on_hand_qty <= reorder_point")
CAT.add("product_list", lambda c: reports.product_list(c, "ECONOMY"), f"SELECT sku, name, category, {r('unit_cost')} AS unit_cost, {r('selling_price')} AS selling_price FROM products WHERE category = 'ECONOMY'")
CAT.add("location_choices", lambda c: reports.choices(c.table("inventory"), "location"), "SELECT DISTINCT location FROM inventory WHERE location IS NOT NULL")
CAT.add("user_access", lambda c: reports.access(c, 1), "SELECT id, true AS sees, CASE WHEN is_super_admin THEN 'Super Admin' WHEN is_admin THEN 'Tenant Admin' ELSE 'User' END AS role, is_admin OR is_super_admin AS gated, true AS exports FROM users")
