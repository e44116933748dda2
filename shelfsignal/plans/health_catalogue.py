"""Queries and oracle SQL of data health and detection quality."""

from __future__ import annotations

import datetime as dt

from ..operators import health, metrics, reports
from .operations_catalogue import NOW, OPEN, hours, pct
from .registry import Catalogue, r

CAT = Catalogue()
_PART = {"sales": "part_sales", "products": "part_products"}
_DAY = "TIMESTAMP '2001-08-01 00:00:00'"

# Data health. The oracle counts each column of each table on its own.


def _one(name: str, tables: dict[str, str]) -> str:
    table, columns, date, *_ = health.DATASETS[name]
    table = tables.get(table, table)
    newest = {"sales": "CAST(max(date) AS TIMESTAMP)", "inventory": "CAST(max(as_of_date) AS TIMESTAMP)", "purchase_orders": "CAST(max(order_date) AS TIMESTAMP)"}.get(name, "max(updated_at)")
    orphans = f"(SELECT count(*) FROM {table} f WHERE f.sku IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {tables.get('products', 'products')} p WHERE p.sku = f.sku))" if name in health.WITH_SKUS else "0"
    share = " + ".join(f"count({c})::DOUBLE / greatest(count(*), 1)" for c in columns)
    return f"SELECT '{name}' AS dataset, count(*) AS received, {newest} AS newest, {orphans} AS orphans, ({share}) / {len(columns)} AS filled FROM {table}"


def _measured(tables: dict[str, str]) -> str:
    return " UNION ALL ".join(_one(name, tables) for name in health.DATASETS)


_DEFAULTS = ", ".join(f"('{name}', {d[3]}, {float(d[4])}, {float(d[5])})" for name, d in health.DATASETS.items())
_LIMITS = f"SELECT d.dataset, coalesce(s.freshness_max_hours, d.h) AS mh, coalesce(CAST(s.completeness_min_pct AS DOUBLE), d.c) AS mc, coalesce(CAST(s.rejection_max_pct AS DOUBLE), d.j) AS mj FROM (VALUES {_DEFAULTS}) AS d(dataset, h, c, j) LEFT JOIN health_settings s ON s.dataset = d.dataset"
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY id DESC) AS k FROM runs) WHERE k = 1"
_VALID = "greatest(0.0, least(100.0, coalesce(CAST(l.validation_score AS DOUBLE), round(CAST(l.rows_imported AS DOUBLE) / CAST(l.rows_processed AS DOUBLE) * 100 + 1e-9, 1))))"


def _snapshots(tables: dict[str, str]) -> str:
    parts = f"""SELECT m.*, t.mh, t.mc, t.mj, CAST(round(coalesce(abs({hours(_DAY, 'm.newest')}), abs({hours(NOW, 'coalesce(l.completed_at, l.started_at)')})) + 1e-9) AS BIGINT) AS hours, round(filled * 100 + 1e-9, 1) AS completeness,
        CASE WHEN l.rows_processed > 0 THEN {_VALID} ELSE 100.0 END AS validity, CASE WHEN l.rows_processed > 0 THEN l.rows_imported ELSE received END AS accepted, CASE WHEN l.rows_processed > 0 THEN l.rows_failed ELSE 0 END AS rejected,
        CASE WHEN received > 0 THEN greatest(0.0, round((1 - CAST(orphans AS DOUBLE) / received) * 100 + 1e-9, 1)) ELSE 100.0 END AS ref FROM ({_measured(tables)}) m JOIN ({_LIMITS}) t ON t.dataset = m.dataset LEFT JOIN ({_LAST}) l ON l.data_type = m.dataset"""
    scored = f"""SELECT *, CASE WHEN hours IS NULL THEN 0.0 WHEN hours <= mh THEN 100.0 ELSE round(greatest(0.0, 100 - (hours - mh) / greatest(2.0 * mh, 1) * 100) + 1e-9, 1) END AS freshness, round(CAST(rejected AS DOUBLE) / greatest(received, 1) * 100 + 1e-9, 1) AS rejection FROM ({parts})"""
    plain = lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"
    label = "upper(dataset[1]) || dataset[2:]"
    warned = f"""SELECT *, round(0.35 * freshness + 0.25 * completeness + 0.25 * validity + 0.15 * ref + 1e-9, 1) AS points, list_filter([
        CASE WHEN received = 0 THEN {{'level': 'critical', 'message': 'No ' || dataset || ' data has been ingested yet.'}} END,
        CASE WHEN received > 0 AND hours > mh THEN {{'level': CASE WHEN hours > 2 * mh THEN 'critical' ELSE 'warning' END, 'message': {label} || ' data is ' || hours || ' hours old (threshold ' || mh || 'h). Conclusions relying on it may be incomplete.'}} END,
        CASE WHEN received > 0 AND completeness < mc THEN {{'level': 'warning', 'message': {label} || ' completeness ' || {plain('completeness')} || '% is below the ' || {plain('mc')} || '% target.'}} END,
        CASE WHEN received > 0 AND rejection > mj THEN {{'level': 'warning', 'message': 'Rejection rate ' || {plain('rejection')} || '% exceeds the ' || {plain('mj')} || '% threshold (possible rejection spike).'}} END,
        CASE WHEN received > 0 AND orphans > 0 THEN {{'level': CASE WHEN ref < 90 THEN 'critical' ELSE 'warning' END, 'message': orphans || ' ' || dataset || ' record(s) reference a SKU with no matching product.'}} END], lambda x: x IS NOT NULL) AS w FROM ({scored})"""
    return f"""SELECT *, CASE WHEN received = 0 THEN 'no_data' WHEN len(list_filter(w, lambda x: x.level = 'critical')) > 0 OR points < 60 THEN 'critical' WHEN points < 85 OR len(w) > 0 THEN 'warning' ELSE 'healthy' END AS status, CASE WHEN received > 0 THEN points END AS score FROM ({warned})"""


_PARTS, _ALL = {"sales": "part_sales", "products": "part_products"}, _snapshots({"sales": "part_sales", "products": "part_products"})
_COLUMNS = " UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS received, '{c}' AS \"column\", round(count({c})::DOUBLE / count(*) * 100 + 1e-9, 1) AS pct FROM {d[0]}" for name, d in health.DATASETS.items() for c in d[1])
CAT.add("health_completeness", health.completeness, f"SELECT dataset, received, \"column\", {r('pct')} AS pct FROM ({_COLUMNS})")
CAT.add("health_thresholds", health.thresholds, f"SELECT dataset, CAST(mh AS BIGINT) AS max_hours, {r('mc')} AS min_completeness, {r('mj')} AS max_rejection FROM ({_LIMITS})")
CAT.add("health_freshness", health.freshness, f"SELECT dataset, hours, CAST(mh AS BIGINT) AS max_hours, {r('freshness')} AS freshness FROM ({_ALL})", **_PART)
CAT.add("health_validity", health.validity, f"SELECT data_type AS dataset, {r(_VALID)} AS validity, rows_imported AS accepted, rows_failed AS rejected FROM ({_LAST}) l WHERE rows_processed > 0")
CAT.add("health_referential", health.referential, f"SELECT dataset, received, orphans, {r('ref')} AS referential FROM ({_ALL}) WHERE dataset IN ('sales', 'inventory', 'purchase_orders')", **_PART)
CAT.add("health_score", health.scores, f"SELECT dataset, status, {r('score')} AS score, CASE WHEN received > 0 THEN hours END AS hours, {r('CASE WHEN received > 0 THEN completeness END')} AS completeness, {r('CASE WHEN received > 0 THEN validity END')} AS validity, received, CASE WHEN received > 0 THEN accepted ELSE 0 END AS accepted, CASE WHEN received > 0 THEN rejected ELSE 0 END AS rejected, len(w) AS n_warnings FROM ({_ALL})", **_PART)
CAT.add("health_warnings", health.warnings, f"SELECT dataset, x.level AS level, x.message AS message FROM (SELECT dataset, unnest(w) AS x FROM ({_ALL}))", **_PART)
CAT.add("health_overall", health.overall, f"SELECT CASE WHEN bool_or(status IN ('critical', 'no_data')) THEN 'critical' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'healthy' END AS status, {r('round(avg(score) + 1e-9, 1)')} AS score, count(*) AS datasets, CAST(sum(len(w)) AS BIGINT) AS n_warnings FROM ({_ALL})", **_PART)
CAT.add("health_affected_investigations", lambda c: health.affected_investigations(c, "inventory"), f"SELECT id, status, priority FROM investigations WHERE {OPEN} AND id IN (SELECT investigation_id FROM evidence WHERE source IN ('inventory_levels', 'inventory', 'inventory_snapshots')) ORDER BY opened_at DESC, id LIMIT 25")
CAT.add(
    "health_evidence_caveats",
    health.evidence_caveats,
    f"SELECT investigation_id, string_agg(dataset || ' data is ' || coalesce(hours || 'h old', 'unavailable'), '; ' ORDER BY dataset) AS caveats FROM (SELECT DISTINCT investigation_id, CASE source WHEN 'sales_transactions' THEN 'sales' WHEN 'inventory_levels' THEN 'inventory' WHEN 'po' THEN 'purchase_orders' WHEN 'supplier' THEN 'suppliers' ELSE source END AS d FROM evidence) e JOIN ({_ALL}) s ON s.dataset = e.d WHERE status <> 'healthy' GROUP BY 1",
    **_PART,
)
CAT.add("health_recipients", health.recipients, "SELECT string_agg(email, ',' ORDER BY email) AS emails FROM users WHERE is_admin")

# Detection quality
_TAKEN = "SELECT investigation_id FROM actions"
_STAGES = {
    "Potential anomalies": "anomalies",
    "Investigations": "investigations",
    "Reviewed / accepted": "investigations WHERE status IN ('in_progress', 'resolved', 'closed')",
    "Actionable": f"investigations WHERE id IN ({_TAKEN})",
    "Action taken": f"investigations WHERE id IN ({_TAKEN} WHERE status = 'completed')",
    "Resolved": "investigations WHERE status IN ('resolved', 'closed')",
    "Observed recovery": "outcomes WHERE outcome_state IN ('observed_recovery', 'partial_recovery')",
}
CAT.add("quality_funnel", metrics.funnel, " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) AS n FROM {v}" for k, v in _STAGES.items()))
_COUNTS = {
    "n": "anomalies", "fp": "anomalies WHERE is_false_positive", "d": "anomalies WHERE dismissed_at IS NOT NULL", "inv": "investigations", "snoozed": f"investigations WHERE snoozed_until > {NOW}",
    "res": "investigations WHERE status IN ('resolved', 'closed')", "narrated": "investigations WHERE narrated_at IS NOT NULL", "est": "investigations WHERE ai_confidence = 'established'", "act": "actions", "done": "actions WHERE status = 'completed'",
    "live": f"suppressions WHERE active AND starts_at <= {NOW} AND (expires_at IS NULL OR expires_at > {NOW})",
}
_RATES = f"""SELECT {pct('n - d', 'n')} AS acceptance, {pct('fp', 'n')} AS false_positive, {pct('greatest(0, d - fp)', 'n')} AS dismissal, {pct('snoozed', 'inv')} AS snooze, live AS active_suppressions, hits AS suppressed_matches, {pct('est', 'narrated')} AS established_cause,
    {pct('done', 'act')} AS action_completion, {pct('res', 'inv')} AS resolution, n AS anomalies, inv AS investigations, act AS actions, res AS resolved FROM (SELECT {', '.join(f'(SELECT count(*) FROM {v}) AS {k}' for k, v in _COUNTS.items())}, (SELECT CAST(sum(match_count) AS BIGINT) FROM suppressions) AS hits)"""
_SHARES = ("acceptance", "false_positive", "dismissal", "snooze", "established_cause", "action_completion", "resolution")
CAT.add("quality_rates", metrics.rates, f"SELECT {', '.join(f'{r(c)} AS {c}' for c in _SHARES)}, active_suppressions, suppressed_matches, anomalies, investigations, actions, resolved FROM ({_RATES})")
CAT.add("quality_score", metrics.quality_score, f"SELECT resolved AS sample_size, resolved >= 20 AS available, {r('CASE WHEN resolved >= 20 THEN round((acceptance + 100 - false_positive + resolution + action_completion) / 4 + 1e-9, 1) END')} AS quality_score FROM ({_RATES})")
CAT.add("quality_evidence_strength", metrics.evidence_strength, "SELECT count(*) FILTER (WHERE strength = 'strong') AS strong, count(*) FILTER (WHERE strength = 'moderate') AS moderate, count(*) FILTER (WHERE strength = 'weak') AS insufficient FROM evidence WHERE investigation_id IN (SELECT id FROM investigations)")
CAT.add(
    "quality_action_statuses",
    metrics.action_quality,
    "SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status IN ('unassigned', 'assigned', 'acknowledged')) AS open, (SELECT count(*) FROM outcomes WHERE outcome_state IN ('observed_recovery', 'partial_recovery')) AS completed_with_recovery FROM actions",
)
CAT.add(
    "report_health",
    lambda c: reports.health_report(c, dt.date(2024, 1, 5), dt.date(2024, 1, 25)),
    f"SELECT {r('h.score')} AS score, h.datasets, h.n_warnings, a.n AS anomalies, i.n AS investigations, {r(pct('i.done', 'i.n'))} AS resolution_rate FROM (SELECT round(avg(score) + 1e-9, 1) AS score, count(*) AS datasets, CAST(sum(len(w)) AS BIGINT) AS n_warnings FROM ({_ALL})) h, (SELECT count(*) AS n FROM anomalies WHERE CAST(detected_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') a, (SELECT count(*) AS n, count(*) FILTER (WHERE status IN ('resolved', 'closed')) AS done FROM investigations WHERE CAST(opened_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25') i",
    **_PART,
)
