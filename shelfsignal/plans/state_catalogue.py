"""Queries and oracle SQL of committed state, periods' reports, and what changes investigations in bulk."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions.dates import natural_date
from ..functions.shared import shared_dir
from ..operators import books, investigations, metrics, outcomes, reports, runs
from ..sources import imports
from ..sources.store import Store
from .operations_catalogue import _FIRED, _KEYED, _MENTION, _NEW, _OLD, _REC, NAME, NOW, OPEN, PRI, SEV, _records, _runs, pct
from .registry import Catalogue, r
from .rules_catalogue import T

CAT = Catalogue()
_PERIOD = (dt.date(2024, 1, 1), dt.date(2024, 1, 29))
_LABEL = "CASE {0} WHEN 'po_overdue' THEN 'PO Overdue' WHEN 'sku_master_drift' THEN 'SKU Master Drift' WHEN 'slow_moving_capital' THEN 'Slow-Moving Capital' WHEN 'multi_location_imbalance' THEN 'Multi-Location Imbalance' WHEN 'duplicate_transaction_ids' THEN 'Duplicate Transaction IDs' ELSE array_to_string(list_transform(string_split({0}, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') END"
_WORDS = "array_to_string(list_transform(string_split({}, '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_CAP = "upper({0}[1]) || {0}[2:]"


def _in(column: str) -> str:
    return f"CAST({column} AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-29'"


# Committed state


class Killed(RuntimeError):
    """Stands for a run that ends before it commits."""


def _committed(c):
    """State after a run that is killed half-way and two whole ones, as the last version has it."""
    spark = c.table("anomalies").sparkSession
    store = Store(spark, f"{shared_dir(spark)}/state/{uuid.uuid4().hex}")
    old, new = _runs(c)
    runs.load(store, anomalies=old, investigations=c.table("investigations"), suppressions=c.table("suppressions"))
    try:
        with store.begin() as t:
            t.write("anomalies", runs.merged_anomalies(t.read("anomalies"), new, c.clock()))
            raise Killed
    except Killed:
        pass
    runs.detection_run(store, c, new)
    runs.detection_run(store, c, new)
    return store


_SAME = "o.rule_type = n.rule_type AND o.sku = n.sku AND o.store_id IS NOT DISTINCT FROM n.store_id"
_AFTER = f"""SELECT rule_type, sku, store_id, severity, revenue_impact, id AS kept_id, investigation_id, true AS dismissed FROM anomalies WHERE id % 2 = 0 AND dismissed_at IS NOT NULL
    UNION ALL SELECT n.rule_type, n.sku, n.store_id, n.severity, n.revenue_impact, o.id, o.investigation_id, false FROM ({_KEYED}) n LEFT JOIN ({_OLD}) o ON {_SAME}
    UNION ALL SELECT rule_type, sku, store_id, severity, revenue_impact, NULL, NULL, false FROM ({_NEW}) WHERE sku IS NULL"""
CAT.add(
    "committed_anomalies",
    lambda c: _committed(c).read("anomalies").select("rule_type", "sku", "store_id", "severity", "revenue_impact", F.when((F.col("id") % 2 == 0) & (F.col("detected_at").cast("timestamp_ntz") < c.clock()), F.col("id")).alias("kept_id"), F.col("dismissed_at").isNotNull().alias("dismissed")),
    f"SELECT rule_type, sku, store_id, severity, {r('revenue_impact')} AS revenue_impact, kept_id, dismissed FROM ({_AFTER})",
)
_FOUND = f"""WITH f AS ({_AFTER}), live AS (SELECT * FROM suppressions WHERE active AND starts_at <= {NOW} AND (expires_at IS NULL OR expires_at > {NOW})),
    g AS (SELECT f.*, investigation_id IS NULL AND NOT dismissed AND NOT EXISTS (SELECT 1 FROM live s WHERE s.rule_type = f.rule_type AND CASE s.scope_type WHEN 'rule' THEN true WHEN 'rule_store' THEN f.store_id = s.store_id WHEN 'rule_sku' THEN f.sku = s.sku ELSE f.store_id = s.store_id AND f.sku = s.sku END) AS waits FROM f),
    o AS (SELECT primary_sku, arg_max(id, (opened_at, id)) AS iid FROM investigations WHERE {OPEN} AND opened_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1),
    m AS (SELECT g.*, CASE WHEN waits THEN o.iid ELSE investigation_id END AS iid, waits AND o.iid IS NULL AS opens FROM g LEFT JOIN o ON g.sku IS NOT DISTINCT FROM o.primary_sku)"""
CAT.add(
    "committed_investigations",
    lambda c: _committed(c).read("investigations").where("anomaly_count > 0").select("primary_sku", F.when(F.col("opened_at").cast("timestamp_ntz") < c.clock(), F.col("id")).alias("old_id"), "status", "priority", "anomaly_count", "revenue_at_risk"),
    f"""{_FOUND}, touched AS (SELECT DISTINCT iid FROM m WHERE waits AND iid IS NOT NULL),
    n AS (SELECT iid, count(*) AS n, sum(revenue_impact) AS v, max({SEV}) AS w FROM m WHERE iid IN (SELECT iid FROM touched) GROUP BY 1)
    SELECT i.primary_sku, i.id AS old_id, i.status, CASE WHEN n.iid IS NULL THEN i.priority ELSE {NAME.format('greatest(n.w, ' + PRI.format('i.priority') + ')')} END AS priority, coalesce(n.n, i.anomaly_count) AS anomaly_count, {r('CASE WHEN n.iid IS NULL THEN i.revenue_at_risk ELSE n.v END')} AS revenue_at_risk FROM investigations i LEFT JOIN n ON n.iid = i.id
    UNION ALL SELECT sku, NULL, 'open', {NAME.format('w')}, n, {r('v')} FROM (SELECT sku, count(*) AS n, coalesce(sum(revenue_impact), 0) AS v, max({SEV}) AS w FROM m WHERE opens GROUP BY 1)""",
)


def _parts(c):
    """Facts kept by import: appended, some imports undone, one replaced."""
    spark = c.table("imported_sales").sparkSession
    facts = c.table("imported_sales").withColumn("import_id", F.col("import_id") % 20)
    store = Store(spark, f"{shared_dir(spark)}/state/{uuid.uuid4().hex}")
    with store.begin() as t:
        t.append("facts", facts, by="import_id")
    with store.begin() as t:
        t.drop("facts", [3, 7])
        t.replace("facts", facts.where("import_id = 5").withColumn("quantity", (F.col("quantity") * 2).cast("decimal(12,2)")), by="import_id")
    return store.read("facts")


CAT.add(
    "facts_by_import",
    lambda c: _parts(c).groupBy("import_id").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity")),
    f"SELECT import_id % 20 AS import_id, count(*) AS rows, {r('sum(quantity * CASE WHEN import_id % 20 = 5 THEN 2 ELSE 1 END)')} AS quantity FROM imported_sales WHERE import_id % 20 NOT IN (3, 7) GROUP BY 1",
)

# Changes to investigations and suppressions
CAT.add("suppressions_expired", lambda c: investigations.suppressions_expired(c).select("id", "active", F.col("ended_at").isNotNull().alias("ended")), f"SELECT id, active AND NOT coalesce(expires_at <= {NOW}, false) AS active, active AND coalesce(expires_at <= {NOW}, false) AS ended FROM suppressions")
CAT.add("snoozes_cleared", lambda c: investigations.snoozes_cleared(c).select("id", F.col("snoozed_until").isNotNull().alias("snoozed")), f"SELECT id, snoozed_until > {NOW} AND snoozed_until IS NOT NULL AS snoozed FROM investigations")
CAT.add(
    "investigations_escalated",
    lambda c: investigations.escalated(c).select("id", "priority", "assigned_team_id", "assigned_user_id", F.col("assigned_at").isNotNull().alias("assigned")),
    f"""SELECT i.id, CASE WHEN x.escalation_action = 'elevate_priority' THEN {NAME.format('least(4, ' + PRI.format('i.priority') + ' + 1)')} ELSE i.priority END AS priority, CASE WHEN x.escalation_action = 'reassign_team' THEN coalesce(x.target_team_id, i.assigned_team_id) ELSE i.assigned_team_id END AS assigned_team_id,
      CASE WHEN x.escalation_action = 'reassign_user' THEN x.target_user_id END AS assigned_user_id, i.assigned_at IS NOT NULL OR coalesce(CASE x.escalation_action WHEN 'reassign_team' THEN x.target_team_id WHEN 'reassign_user' THEN x.target_user_id END, 0) > 0 AS assigned
    FROM investigations i LEFT JOIN ({_FIRED}) f ON f.investigation_id = i.id LEFT JOIN escalation_rules x ON x.id = f.rule_id""",
)
_ASKED = "SELECT id FROM users WHERE id % 3 = 0"
for _action, _arguments, _want in (
    ("reassign_team", {"team_id": 4}, ("assigned_team_id", "CASE WHEN hit THEN 4 ELSE assigned_team_id END")),
    ("change_priority", {"priority": "high"}, ("priority", "CASE WHEN hit THEN 'high' ELSE priority END")),
    ("snooze", {"duration": "3d"}, ("snoozed_until", f"strftime(CASE WHEN hit THEN {NOW} + INTERVAL 3 DAY ELSE snoozed_until END, '%Y-%m-%d')")),
    ("dismiss", {}, ("status", "CASE WHEN hit THEN 'closed' ELSE status END")),
):
    CAT.add(
        f"bulk_{_action}",
        lambda c, a=_action, k=_arguments, w=_want: investigations.bulk(c, c.table("users").where("id % 3 = 0").select("id"), a, 5, **k)[0].select("id", (F.date_format(w[0], "yyyy-MM-dd") if a == "snooze" else F.col(w[0])).alias("value")),
        f"SELECT id, {_want[1]} AS value FROM (SELECT *, id IN ({_ASKED}) AS hit FROM investigations)",
    )
CAT.add("bulk_failures", lambda c: investigations.bulk(c, c.table("users").where("id % 3 = 0").select("id"), "assign_to_me", 5)[1], f"SELECT id, CASE WHEN id NOT IN (SELECT id FROM investigations) THEN 'Not found in tenant scope' END AS failure FROM ({_ASKED})")
_EACH = f"SELECT comment_id, NULL::BIGINT AS team_id, user_id FROM ({_MENTION} UNION SELECT comment_id, user_id FROM comment_users) UNION ALL SELECT t.comment_id, t.team_id, m.user_id FROM (SELECT DISTINCT comment_id, team_id FROM comment_teams WHERE team_id IN (SELECT id FROM teams)) t JOIN team_members m ON m.team_id = t.team_id UNION ALL SELECT DISTINCT comment_id, team_id, NULL FROM comment_teams WHERE team_id IN (SELECT id FROM teams)"
CAT.add("mentions_expanded", investigations.all_mentions, _EACH)
CAT.add("mentioned_users", investigations.mentioned_users, f"SELECT DISTINCT e.comment_id, e.user_id FROM ({_EACH}) e JOIN (SELECT id AS cid, author_id FROM comments) c ON c.cid = e.comment_id WHERE e.user_id IS NOT NULL AND e.user_id <> c.author_id")


def _recorded(c):
    return outcomes.record(c, _records(c).withColumnRenamed("revenue_recovered", "observed_recovery"))


CAT.add(
    "outcome_record_at_risk",
    lambda c: _recorded(c)[0].select("investigation_id", "revenue_at_risk", "rule_feedback_sent", F.col("recorded_at").isNotNull().alias("recorded")),
    f"SELECT coalesce(o.investigation_id, q.investigation_id) AS investigation_id, {r('coalesce(q.estimate, o.revenue_at_risk)')} AS revenue_at_risk, coalesce(q.was_false_positive, false) AS rule_feedback_sent, true AS recorded FROM outcomes o FULL JOIN (SELECT x.*, i.revenue_at_risk AS estimate FROM ({_REC}) x JOIN (SELECT id, revenue_at_risk FROM investigations) i ON i.id = x.investigation_id) q ON q.investigation_id = o.investigation_id",
)
CAT.add("outcome_record_write_back", lambda c: _recorded(c)[1].select("id", "observed_recovery"), f"SELECT i.id, {r('q.revenue_recovered')} AS observed_recovery FROM investigations i LEFT JOIN ({_REC}) q ON q.investigation_id = i.id")

# Digests and the figures behind money cards


def _tenants(c):
    return c.table("anomalies").withColumn("tenant_id", F.expr("id div 7 % 5")), c.table("teams").select("id", F.when(F.col("id") != 2, F.concat(F.lit("t"), "id")).alias("notification_email"), (F.col("id") % 2 == 0).alias("notify_on_high"), (F.col("id") > 2).alias("notify_on_medium"))


_TOLD = "SELECT id, id // 7 % 5 AS tenant_id, rule_type, severity, sku, detected_at FROM anomalies WHERE dismissed_at IS NULL AND notified_at IS NULL AND ((severity = 'high' AND id // 7 % 5 IN (0, 4)) OR (severity = 'medium' AND id // 7 % 5 IN (3, 4)))"
CAT.add("digest_by_tenant", lambda c: reports.digests(_tenants(c)[1], _tenants(c)[0], c.clock())[0].drop("notification_email"), f"SELECT tenant_id, id, rule_type, severity, sku, row_number() OVER (PARTITION BY tenant_id ORDER BY {SEV} DESC, detected_at DESC, id) AS place FROM ({_TOLD})")
CAT.add("digest_marks", lambda c: reports.digests(_tenants(c)[1], _tenants(c)[0], c.clock())[1].select("id", (F.col("notified_at") == c.clock()).alias("told_now")), f"SELECT id, CASE WHEN id IN (SELECT id FROM ({_TOLD})) THEN true WHEN notified_at IS NOT NULL THEN false END AS told_now FROM anomalies")
_O = "FROM outcomes"
_MONTH = "CAST(recorded_at AS DATE) >= DATE '2024-01-01'"
_PARTS = [
    ("revenue_at_risk", "Open / in-progress investigations", f"count(*) FROM investigations WHERE {OPEN}"), ("revenue_at_risk", "With a revenue-at-risk estimate", f"count(*) FROM investigations WHERE {OPEN} AND revenue_at_risk > 0"), ("revenue_at_risk", "Total revenue at risk", f"coalesce(sum(revenue_at_risk), 0) FROM investigations WHERE {OPEN}"),
    ("recovered_mtd", "Outcomes recorded this month", f"count(*) {_O} WHERE {_MONTH} AND revenue_recovered > 0"), ("recovered_mtd", "Total observed recovery", f"coalesce(sum(revenue_recovered), 0) {_O} WHERE {_MONTH}"),
    ("outcome_at_risk", "Recorded outcomes", f"count(*) {_O}"), ("outcome_at_risk", "Total revenue at risk", f"sum(revenue_at_risk) {_O}"), ("observed_recovery", "Total revenue at risk", f"sum(revenue_at_risk) {_O}"), ("observed_recovery", "Total observed recovery", f"sum(revenue_recovered) {_O}"),
    ("observed_recovery", "Investigations resolved", "count(*) FROM investigations WHERE status IN ('resolved', 'closed')"), ("recovery_rate", "Total observed recovery", f"sum(revenue_recovered) {_O}"), ("recovery_rate", "Total revenue at risk", f"sum(revenue_at_risk) {_O}"),
    ("recovery_rate", "Recovery rate", f"{pct('sum(revenue_recovered)', 'sum(revenue_at_risk)')} {_O}"), ("false_positives", "Investigations closed as false positive", f"count(*) {_O} WHERE was_false_positive"),
]
CAT.add("financial_breakdown_components", reports.breakdown_components, " UNION ALL ".join(f"SELECT '{m}' AS metric, '{k}' AS component, {r(f'(SELECT {of})')} AS value" for m, k, of in _PARTS))

# Reports of a period
_OUT = f"SELECT * FROM outcomes WHERE {_in('recorded_at')}"
_KEYS = f"""SELECT o.*, coalesce({_LABEL.format('a.c')}, 'Uncategorised') AS cause, coalesce(s.name, 'Unassigned') AS store, {_WORDS.format("coalesce(x.t, 'no_action')")} AS act FROM ({_OUT}) o LEFT JOIN (SELECT investigation_id, arg_max(rule_type, (detected_at, id)) AS c FROM anomalies WHERE investigation_id IS NOT NULL GROUP BY 1) a ON a.investigation_id = o.investigation_id
    LEFT JOIN (SELECT investigation_id, arg_max(action_type, (completed_at, id)) AS t FROM actions WHERE status = 'completed' GROUP BY 1) x ON x.investigation_id = o.investigation_id LEFT JOIN (SELECT id AS iid, primary_store_id FROM investigations) i ON i.iid = o.investigation_id LEFT JOIN stores s ON s.id = i.primary_store_id"""
_SUMS = f"{r('round(sum(coalesce(revenue_recovered, 0)), 2)')} AS recovered, {r('round(sum(coalesce(revenue_at_risk, 0)), 2)')} AS at_risk, count(*) AS outcomes"
CAT.add("report_recovery_sections", lambda c: books.recovery_sections(c, *_PERIOD), " UNION ALL ".join(f"SELECT '{name}' AS section, {key} AS key, {_SUMS} FROM ({_KEYS}) GROUP BY 2" for name, key in (("Recovery by cause", "cause"), ("Recovery by store", "store"), ("Recovery by action", "act"))))
CAT.add(
    "report_outcome_register",
    lambda c: books.outcome_register(c, *_PERIOD),
    f"""SELECT o.investigation_id AS "Investigation", coalesce(i.title, '') AS "Title", coalesce(i.primary_sku, '') AS "SKU", CASE outcome_type WHEN 'false_positive' THEN 'False Positive' ELSE {_CAP.format('outcome_type')} END AS "Outcome", {_WORDS.format('outcome_state')} AS "State", {r('coalesce(o.revenue_at_risk, 0)')} AS "Revenue at Risk", {r('coalesce(revenue_recovered, 0)')} AS "Observed Recovery",
      {r('coalesce(action_cost, 0)')} AS "Cost to Resolve", CASE WHEN recovery_method IS NULL THEN '—' WHEN recovery_method = 'other_way' THEN 'Other_way' ELSE {_WORDS.format('recovery_method')} END AS "Recovery Method", strftime(recorded_at, '%Y-%m-%d %H:%M') AS "Recorded" FROM ({_OUT}) o LEFT JOIN investigations i ON i.id = o.investigation_id""",
)
_INV = f"SELECT * FROM investigations WHERE {_in('opened_at')}"
CAT.add("report_investigation_sections", lambda c: books.investigation_sections(c, *_PERIOD), f"SELECT 'By status' AS section, {_WORDS.format('status')} AS key, count(*) AS n FROM ({_INV}) GROUP BY 2 UNION ALL SELECT 'By priority', {_CAP.format('priority')}, count(*) FROM ({_INV}) GROUP BY 2")
CAT.add(
    "report_investigation_register",
    lambda c: books.investigation_register(c, *_PERIOD),
    f"""SELECT i.id AS "ID", i.title AS "Title", coalesce(primary_sku, '') AS "SKU", coalesce(s.name, '') AS "Store", {_WORDS.format('i.status')} AS "Status", {_CAP.format('i.priority')} AS "Priority", coalesce(t.name, '') AS "Team", coalesce(anomaly_count, 0) AS "Anomalies", {r('coalesce(i.revenue_at_risk, 0)')} AS "Revenue at Risk", {r('coalesce(o.revenue_recovered, 0)')} AS "Observed Recovery",
      coalesce(strftime(opened_at, '%Y-%m-%d %H:%M'), '') AS "Opened", coalesce(strftime(resolved_at, '%Y-%m-%d %H:%M'), '') AS "Resolved" FROM ({_INV}) i LEFT JOIN stores s ON s.id = i.primary_store_id LEFT JOIN teams t ON t.id = i.assigned_team_id LEFT JOIN outcomes o ON o.investigation_id = i.id""",
)
_ANO = f"SELECT * FROM anomalies WHERE {_in('detected_at')}"
_TALLY = "count(*) AS detections, count(dismissed_at) AS dismissed, count(*) FILTER (WHERE is_false_positive) AS false_positives"
CAT.add("report_anomaly_sections", lambda c: books.anomaly_sections(c, *_PERIOD), f"SELECT 'By rule' AS section, {_LABEL.format('rule_type')} AS key, {_TALLY} FROM ({_ANO}) GROUP BY 2 UNION ALL SELECT 'By severity', {_CAP.format('severity')}, {_TALLY} FROM ({_ANO}) GROUP BY 2")
CAT.add(
    "report_anomaly_register",
    lambda c: books.anomaly_register(c, *_PERIOD),
    f"""SELECT a.id AS "ID", {_LABEL.format('rule_type')} AS "Rule", {_CAP.format('severity')} AS "Severity", coalesce(sku, '') AS "SKU", coalesce(s.name, '') AS "Store", strftime(detected_at, '%Y-%m-%d %H:%M') AS "Detected", coalesce(CAST(investigation_id AS VARCHAR), '') AS "Investigation", CASE WHEN dismissed_at IS NULL THEN 'No' ELSE 'Yes' END AS "Dismissed", CASE WHEN is_false_positive THEN 'Yes' ELSE 'No' END AS "False Positive"
      FROM ({_ANO}) a LEFT JOIN stores s ON s.id = a.store_id""",
)
CAT.add("noisy_skus_with_false_positives", metrics.noisy_skus, "SELECT sku, count(*) AS anomalies, count(*) FILTER (WHERE is_false_positive) AS false_positives FROM anomalies WHERE sku IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")

# Dates as people write them, and users of other tenants
_FORMS = ["yyyy-MM-dd", "d MMMM yyyy", "MMM d, yyyy", "EEEE, MMMM d yyyy", "dd-MMM-yyyy", "MM/dd/yyyy", "dd.MM.yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd", "MMM d, yyyy h:mm a"]


def _written(c):
    """Each order's day in one of ten forms, or as days before the as-of day."""
    o = c.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    at = F.col("d").cast("timestamp") + F.expr("INTERVAL '9' HOUR")
    forms = F.element_at(F.array(*(F.date_format(at, f) for f in _FORMS), F.concat(F.datediff(c.day(), "d").cast("string"), F.lit(" days ago")), F.upper(F.date_format(at, "d MMM yyyy"))), (F.col("o_orderkey") % 12 + 1).cast("int"))
    return o.select("o_orderkey", natural_date(forms, c.day()).alias("day"))


CAT.add("natural_dates", _written, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
CAT.add("months_ago", lambda c: c.table("orders").select("o_orderkey", natural_date(F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit(" months ago")), F.col("o_orderdate").cast("date")).alias("day")), "SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) - to_months(CAST(o_orderkey % 30 AS INTEGER)) AS DATE) + CAST(day(CAST(o_orderdate AS DATE)) - 1 AS INTEGER) AS day FROM orders")
CAT.add(
    "foreign_users",
    lambda c: imports.foreign_users(imports.validate(c.table("users").select(F.when(F.col("id") % 9 > 0, F.col("name")).alias("name"), "email", F.col("id").alias("_order")), "users"), c.table("users").withColumn("tenant_id", F.col("id") % 4), 1).select("_order", F.col("error").alias("error")),
    "SELECT id AS _order, CASE WHEN id % 9 = 0 THEN 'Missing required field: name' WHEN id % 4 <> 1 THEN 'user ''' || email || ''' already exists under a different tenant.' END AS error FROM users",
)
