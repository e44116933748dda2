"""The driver's star schema as canonical tables: one SQL text for Spark and for the oracle."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re

from pyspark.sql import DataFrame, SparkSession

from ..context import Context
from ..schema import RULES

AS_OF = dt.date(2001, 8, 1)
NOW = dt.datetime(2024, 1, 31)
_T = "DATE '2001-08-01'"
_RULE = "CASE {} " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(RULES)) + " END"

#: The key that signs reply tokens here, and the signatures of the numbers that the mails name.
MAIL_KEY = b"inbox"
SIGNED = {n: hmac.new(MAIL_KEY, str(n).encode(), hashlib.sha256).hexdigest()[:16] for n in range(30)}
_SIGNED = "CASE c_custkey % 30 " + " ".join(f"WHEN {n} THEN '{n}-{s}'" for n, s in SIGNED.items()) + " END"

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Canonical name -> query over the sources and over canonical tables named before.
VIEWS: dict[str, str] = {
    "all_sales": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, concat(l_orderkey, '-', l_linenumber) AS transaction_id, CAST(o_orderdate AS DATE) AS date,
               concat(p_brand, '/', p_type) AS sku, CAST(l_partkey AS STRING) AS part_sku, p_type AS category, n_name AS location, CAST(n_nationkey AS BIGINT) AS store_id,
               CAST(l_quantity AS DECIMAL(12,2)) AS quantity, l_extendedprice / l_quantity AS unit_price,
               CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS total_amount, l_returnflag = 'R' AS is_return
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "sales": "SELECT tenant_id, transaction_id, date, sku, category, location, store_id, quantity, unit_price, total_amount FROM all_sales",
    "net_sales": "SELECT tenant_id, transaction_id, date, sku, category, location, store_id, quantity, unit_price, total_amount FROM all_sales WHERE NOT is_return",
    "returns": "SELECT tenant_id, date, sku, location, store_id, quantity, total_amount AS value FROM all_sales WHERE is_return",
    "part_sales": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(o_orderdate AS DATE) AS date, CAST(l_partkey AS STRING) AS sku, concat('L', l_partkey % 25) AS location, l_partkey % 25 AS store_id, CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
               l_extendedprice / l_quantity AS unit_price, CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "early_sales": "SELECT * FROM part_sales WHERE date < DATE '1995-04-01'",
    "brand_sales": """
        SELECT tenant_id, transaction_id, date, category AS sku, location, store_id % 5 AS store_id, quantity, unit_price, total_amount FROM all_sales""",
    "products": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, min(p_partkey) AS id, concat(p_brand, '/', p_type) AS sku, min(p_name) AS name, p_type AS category, p_brand AS subcategory,
               round(avg(p_retailprice), 4) AS selling_price, round(avg(p_retailprice * CASE WHEN p_size % 10 = 0 THEN 1.1 ELSE 0.6 END), 4) AS unit_cost,
               TIMESTAMP '2001-07-20 00:00:00' AS updated_at
        FROM part GROUP BY p_brand, p_type""",
    "part_products": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, p_partkey AS id, CAST(p_partkey AS STRING) AS sku, p_name AS name, p_type AS category, p_brand AS subcategory,
               p_retailprice AS selling_price, p_retailprice * CASE WHEN p_size % 10 = 0 THEN 1.1 ELSE 0.6 END AS unit_cost,
               TIMESTAMP '2001-05-02 00:00:00' AS updated_at
        FROM part WHERE p_partkey % 17 <> 0""",
    "stores": f"""
        SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(n_nationkey AS BIGINT) AS id, n_name AS name, r_name AS region, {_T} - CAST(n_nationkey AS INTEGER) AS created_at,
               CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE concat('S', n_nationkey) END AS code, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_name END AS city,
               CAST(NULL AS STRING) AS address, CAST(NULL AS TIMESTAMP) AS updated_at
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "suppliers": "SELECT CAST(1 AS BIGINT) AS tenant_id, s_suppkey AS id, s_name AS name, s_nationkey AS country, TIMESTAMP '2001-06-01 12:00:00' AS updated_at FROM supplier",
    "inventory": f"""
        SELECT CAST(1 AS BIGINT) AS tenant_id, p_partkey AS id, CAST(p_partkey AS STRING) AS sku, concat('L', p_partkey % 25) AS location, p_partkey % 25 AS store_id,
               CAST((p_partkey * 37) % 200 AS DECIMAL(12,2)) AS on_hand_qty, CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 2 END AS DECIMAL(12,2)) AS reorder_point,
               {_T} - CAST(p_partkey % 150 AS INTEGER) AS as_of_date FROM part
        UNION ALL
        SELECT CAST(1 AS BIGINT), p_partkey + 10000000, CAST(p_partkey AS STRING), concat('L', p_partkey % 25), p_partkey % 25, CAST((p_partkey * 37) % 200 + 40 AS DECIMAL(12,2)),
               CAST(CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 2 END AS DECIMAL(12,2)), {_T} - CAST(p_partkey % 150 + 30 AS INTEGER) FROM part
        UNION ALL
        SELECT CAST(1 AS BIGINT), p_partkey + 20000000, CAST(p_partkey AS STRING), concat('L', (p_partkey + 7) % 25), (p_partkey + 7) % 25, CAST((p_partkey * 53) % 200 AS DECIMAL(12,2)),
               CAST(p_size AS DECIMAL(12,2)), {_T} - CAST(p_partkey % 150 AS INTEGER) FROM part WHERE p_partkey % 13 <> 0""",
    "purchase_orders": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, concat(l_orderkey, '-', l_linenumber) AS po_number, s_name AS supplier, CAST(l_partkey AS STRING) AS sku, CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS DATE) + CAST(14 + l_linenumber AS INTEGER) AS expected_date,
               CASE l_linestatus WHEN 'F' THEN CAST(o_orderdate AS DATE) + CAST((l_partkey + l_linenumber) % 30 AS INTEGER) END AS received_date,
               CAST(l_quantity AS DECIMAL(12,2)) AS qty_ordered, CAST(CASE l_returnflag WHEN 'N' THEN l_quantity WHEN 'A' THEN l_quantity * 0.5 END AS DECIMAL(12,2)) AS qty_received,
               l_extendedprice / l_quantity AS unit_cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "runs": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, CASE event_type WHEN 'view' THEN 'sales' WHEN 'click' THEN 'inventory' WHEN 'purchase' THEN 'purchase_orders' WHEN 'signup' THEN 'products' ELSE 'stores' END AS data_type,
               CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'completed' END AS status, CAST(floor(value * 10) AS BIGINT) AS rows_processed,
               CAST(floor(value * 9) AS BIGINT) AS rows_imported, CAST(floor(value * 10) AS BIGINT) - CAST(floor(value * 9) AS BIGINT) AS rows_failed, ts - INTERVAL '7' MINUTE AS started_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 50 + event_id % 50 END AS validation_score, ts AS completed_at
        FROM events""",
    "anomalies": f"""
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, {_RULE.format('event_id % 27')} AS rule_type,
               CASE WHEN event_id % 10 < 5 THEN 'low' WHEN event_id % 10 < 8 THEN 'medium' ELSE 'high' END AS severity, CAST(user_id AS STRING) AS sku, user_id % 25 AS store_id,
               CAST(value AS DECIMAL(18,2)) AS revenue_impact, ts AS detected_at, CASE WHEN event_type = 'error' THEN ts + INTERVAL '5' MINUTE END AS dismissed_at,
               event_type = 'error' AND event_id % 2 = 0 AS is_false_positive, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS investigation_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS notified_at, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('Seen ', event_id % 8) END AS description, concat(chr(123), '"units_sold":', event_id % 100, ',"window_days":', event_id % 30, chr(125)) AS context,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'detected' END AS investigation_status, CAST(NULL AS STRING) AS action_notes, CASE WHEN event_id % 9 = 0 THEN 'done' END AS resolution_notes, CASE WHEN event_id % 9 = 0 THEN ts + INTERVAL '3' HOUR END AS resolved_at,
               event_id % 4 = 1 AS ai_is_recurring
        FROM events""",
    "investigations": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, user_id AS id, concat('Investigation ', user_id) AS title, CASE user_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
               CASE (user_id % 13) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority, CAST(user_id AS STRING) AS primary_sku, user_id % 25 AS primary_store_id,
               CASE WHEN user_id % 7 = 0 THEN NULL ELSE sum(CAST(value AS DECIMAL(18,2))) END AS revenue_at_risk, CAST(count(*) AS BIGINT) AS anomaly_count, min(ts) AS opened_at,
               CASE WHEN user_id % 5 = 0 THEN NULL ELSE min(ts) + INTERVAL '6' HOUR END AS assigned_at, CASE WHEN user_id % 4 >= 2 THEN max(ts) END AS resolved_at,
               CASE WHEN user_id % 6 = 0 THEN NULL ELSE max(ts) - INTERVAL '2' DAY END AS narrated_at,
               CASE user_id % 11 WHEN 0 THEN TIMESTAMP '2024-02-03 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00' END AS snoozed_until,
               CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'established' WHEN user_id % 3 = 2 THEN 'probable' ELSE 'suspected' END AS ai_confidence,
               CASE WHEN user_id % 5 < 2 THEN NULL ELSE CAST(user_id % 4 AS BIGINT) END AS assigned_team_id, CASE WHEN user_id % 3 = 0 THEN concat('About ', user_id) END AS description
        FROM events GROUP BY user_id""",
    "actions": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, user_id AS investigation_id, concat('Action ', event_id) AS title,
               CASE event_id % 9 WHEN 0 THEN 'reorder' WHEN 1 THEN 'transfer' WHEN 2 THEN 'markdown' WHEN 3 THEN 'supplier_contact' WHEN 4 THEN 'price_change' WHEN 5 THEN 'recount' WHEN 6 THEN 'investigate' WHEN 7 THEN 'escalate' ELSE 'other' END AS action_type,
               CASE event_id % 7 WHEN 0 THEN 'unassigned' WHEN 1 THEN 'assigned' WHEN 2 THEN 'acknowledged' WHEN 3 THEN 'in_progress' WHEN 4 THEN 'blocked' WHEN 5 THEN 'completed' ELSE 'cancelled' END AS status,
               CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 10 END AS assignee_id,
               ts AS created_at, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts + INTERVAL '72' HOUR END AS due_at, CASE WHEN event_id % 7 = 5 THEN ts + INTERVAL '20' HOUR END AS completed_at,
               CASE WHEN event_id % 5 = 0 THEN concat('Call back ', event_id % 10) END AS description, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 7 END AS assigned_team_id
        FROM events WHERE event_type = 'purchase'""",
    "outcomes": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, user_id AS investigation_id, sum(CAST(value AS DECIMAL(18,2))) AS revenue_at_risk,
               CASE WHEN user_id % 6 = 0 THEN NULL ELSE sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) END AS revenue_recovered,
               CAST(user_id % 50 AS DECIMAL(18,2)) AS action_cost, CASE user_id % 5 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'resolved' WHEN 2 THEN 'partially_resolved' WHEN 3 THEN 'unresolved' ELSE 'monitoring' END AS outcome_type,
               CASE user_id % 7 WHEN 0 THEN 'observed_recovery' WHEN 1 THEN 'partial_recovery' WHEN 2 THEN 'no_material_change' WHEN 3 THEN 'insufficient_evidence' ELSE 'monitoring' END AS outcome_state,
               CASE user_id % 7 WHEN 0 THEN 'sales_rebound' WHEN 1 THEN 'manual_estimate' WHEN 2 THEN 'other_way' END AS recovery_method, user_id % 5 = 0 AS was_false_positive, CASE WHEN user_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS next_measurement_at, max(ts) AS recorded_at
        FROM events WHERE user_id % 2 = 0 GROUP BY user_id""",
    "evidence": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, user_id AS investigation_id, event_id AS anomaly_id,
               CASE event_id % 5 WHEN 0 THEN 'sales' WHEN 1 THEN 'inventory' WHEN 2 THEN 'purchase_orders' WHEN 3 THEN 'products' ELSE 'stores' END AS source, concat('Label ', event_id % 12) AS label,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS value_numeric, CASE WHEN event_id % 8 = 0 THEN 'text' END AS value_text, CASE WHEN event_id % 2 = 0 THEN 'units' END AS unit,
               CASE event_id % 6 WHEN 0 THEN 'supports' WHEN 1 THEN 'contradicts' WHEN 3 THEN 'supports' WHEN 4 THEN 'contradicts' WHEN 2 THEN 'context' ELSE 'neutral' END AS direction, CASE (event_id % 7) % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END AS strength, ts AS observed_at
        FROM events WHERE event_type = 'click'""",
    "suppressions": f"""
        SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'rule_store' WHEN 2 THEN 'rule_sku' ELSE 'rule_store_sku' END AS scope_type,
               {_RULE.format('n_nationkey % 27')} AS rule_type, CASE WHEN n_nationkey % 4 IN (1, 3) THEN CAST(n_nationkey AS BIGINT) END AS store_id, CASE WHEN n_nationkey % 4 IN (2, 3) THEN CAST(n_nationkey + 25 AS STRING) END AS sku,
               TIMESTAMP '2024-01-01 00:00:00' AS starts_at, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS expires_at,
               n_nationkey % 6 <> 5 AS active, CAST(n_nationkey % 7 AS BIGINT) AS match_count
        FROM nation""",
    "health_settings": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, CASE r_regionkey WHEN 0 THEN 'sales' WHEN 1 THEN 'inventory' WHEN 2 THEN 'purchase_orders' WHEN 3 THEN 'suppliers' ELSE 'products' END AS dataset,
               CASE r_regionkey WHEN 0 THEN 900 WHEN 3 THEN 1000 WHEN 4 THEN 1500 END AS freshness_max_hours, CASE WHEN r_regionkey = 1 THEN 99.5 END AS completeness_min_pct, CASE WHEN r_regionkey < 3 THEN 1 + 2 * r_regionkey END AS rejection_max_pct
        FROM region""",
    "escalation_rules": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(r_regionkey AS BIGINT) AS id, CASE r_regionkey WHEN 0 THEN 'priority_threshold' WHEN 1 THEN 'time_open' WHEN 2 THEN 'unassigned' WHEN 3 THEN 'no_action' ELSE 'time_open' END AS trigger_type,
               CASE r_regionkey WHEN 0 THEN 'critical' WHEN 1 THEN '600' WHEN 2 THEN '24' WHEN 3 THEN '48' ELSE '48' END AS trigger_value, CASE WHEN r_regionkey IN (1, 3) THEN 'medium' END AS min_priority, CAST(r_regionkey AS BIGINT) AS sort_order,
               CASE r_regionkey WHEN 0 THEN 'elevate_priority' WHEN 1 THEN 'reassign_team' WHEN 2 THEN 'reassign_user' WHEN 3 THEN 'elevate_priority' ELSE 'notify_lead' END AS escalation_action,
               CASE WHEN r_regionkey = 1 THEN CAST(2 AS BIGINT) END AS target_team_id, CASE WHEN r_regionkey = 2 THEN CAST(5 AS BIGINT) END AS target_user_id
        FROM region""",
    "escalation_events": "SELECT CAST(1 AS BIGINT) AS tenant_id, user_id AS investigation_id, CAST(min(event_id) % 5 AS BIGINT) AS rule_id, TIMESTAMP '2024-01-30 12:00:00' AS fired_at FROM events WHERE user_id % 10 = 0 GROUP BY user_id",
    "users": "SELECT CAST(1 AS BIGINT) AS tenant_id, c_custkey AS id, c_name AS name, concat(lower(c_mktsegment), '.', c_custkey, '@example.com') AS email, c_custkey % 20 = 0 AS is_admin, c_custkey % 50 = 7 AS is_super_admin FROM customer",
    "watches": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, uid AS id, uid AS investigation_id, CASE WHEN uid % 4 = 0 THEN NULL ELSE uid % 7 END AS user_id, CASE WHEN uid % 4 = 0 THEN uid % 3 END AS team_id,
               CASE uid % 3 WHEN 0 THEN 'until_resolved' WHEN 1 THEN 'until_date' ELSE 'indefinite' END AS mode, CASE WHEN uid % 3 = 1 AND uid % 2 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' WHEN uid % 3 = 1 THEN TIMESTAMP '2024-02-20 00:00:00' END AS until_date,
               uid % 13 <> 12 AS active, CASE uid % 5 WHEN 0 THEN split('status_change,comment,overdue', ',') WHEN 1 THEN split('recovery,material_impact_change,comment,action_taken', ',') END AS triggers,
               'open' AS last_status, 'low' AS last_priority, CAST(0 AS BIGINT) AS last_actions, CAST(uid % 3 AS BIGINT) AS last_completed, CAST(0 AS BIGINT) AS last_overdue,
               CAST(uid % 2 AS BIGINT) AS last_escalations, CAST(100 * (uid % 9) AS DECIMAL(18,2)) AS last_at_risk, CAST(uid % 50 AS DECIMAL(18,2)) AS last_recovered
        FROM (SELECT DISTINCT user_id AS uid FROM events WHERE user_id % 3 <> 2 OR user_id % 5 = 0)""",
    "watch_ledger": """
        SELECT user_id AS watch_id, CASE user_id % 2 WHEN 0 THEN 'escalation:1' ELSE 'status_change:open->in_progress' END AS signature, TIMESTAMP '2024-01-05 00:00:00' AS sent_at FROM events WHERE user_id % 5 = 0 GROUP BY user_id
        UNION ALL SELECT user_id, concat('comment:', event_id), ts FROM events WHERE event_type = 'signup' AND event_id % 3 = 0""",
    "teams": "SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(r_regionkey AS BIGINT) AS id, concat('Team ', r_name) AS name, r_regionkey IN (1, 3) AS is_default FROM region",
    "team_members": "SELECT CAST(1 AS BIGINT) AS tenant_id, c_custkey % 3 AS team_id, c_custkey AS user_id FROM customer WHERE c_custkey <= 20",
    "cases": f"""
        SELECT CAST(1 AS BIGINT) AS tenant_id, min(p_partkey) AS case_id, concat(p_brand, '/', p_type) AS sku, {_T} - CAST(20 + min(p_partkey) % 40 AS INTEGER) AS detected_on,
               {_T} - CAST(20 + min(p_partkey) % 40 - 18 - min(p_partkey) % 7 AS INTEGER) AS done_on FROM part GROUP BY p_brand, p_type""",
    "case_outcomes": """
        SELECT min(p_partkey) AS investigation_id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'monitoring' ELSE 'partial_recovery' END AS outcome_state, CASE WHEN min(p_partkey) % 3 = 0 THEN 12.5E0 END AS observed_recovery,
               'not_attempted' AS attribution_status, 'insufficient' AS evidence_strength, TIMESTAMP '2001-07-30 00:00:00' AS next_measurement_at
        FROM part WHERE p_size % 2 = 0 GROUP BY p_brand, p_type""",
    "rule_settings": f"SELECT CAST(1 AS BIGINT) AS tenant_id, {_RULE.format('n_nationkey')} AS rule_type, n_nationkey % 9 <> 0 AS enabled FROM nation",
    "audit": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, user_id AS investigation_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS user_id,
               CASE event_id % 3 WHEN 0 THEN 'comment_added' WHEN 1 THEN 'status_changed' ELSE 'outcome_measured' END AS event_type, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN concat(chr(123), '"source":"email"', chr(125)) WHEN event_id % 5 = 0 THEN concat(chr(123), '"source":"web"', chr(125)) END AS new_value
        FROM events WHERE event_type = 'view'""",
    "imports": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, CASE event_id % 6 WHEN 0 THEN 'sales' WHEN 1 THEN 'inventory' WHEN 2 THEN 'products' WHEN 3 THEN 'returns' WHEN 4 THEN 'stores' ELSE 'purchase_orders' END AS data_type,
               CASE event_id % 5 WHEN 0 THEN 'importing' WHEN 1 THEN 'completed' WHEN 2 THEN 'completed_with_errors' WHEN 3 THEN 'failed' ELSE 'mapping_review' END AS status, CAST(NULL AS STRING) AS error_message,
               CASE WHEN event_id % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 10) AS BIGINT) END AS total_rows, CAST(floor(value * 7) AS BIGINT) + event_id % 40 AS process_cursor, CAST(floor(value * 6) AS BIGINT) AS imported_rows, event_id % 9 AS failed_rows,
               CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-30 23:55:00' ELSE ts END AS updated_at
        FROM events WHERE event_type IN ('purchase', 'signup')""",
    "imported_sales": "SELECT l_orderkey % 1500 + 1 AS import_id, concat(l_orderkey, '-', l_linenumber) AS transaction_id, CAST(l_quantity AS DECIMAL(12,2)) AS quantity FROM lineitem",
    "connections": "SELECT CAST(1 AS BIGINT) AS tenant_id, CAST(r_regionkey AS BIGINT) AS id, r_regionkey <> 4 AS active FROM region",
    "feeds": """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS connection_id, CASE n_nationkey % 3 WHEN 0 THEN ' in/ ' WHEN 1 THEN 'out' ELSE '' END AS remote_path, CASE n_nationkey % 4 WHEN 0 THEN 'Sales_*.csv' WHEN 1 THEN '' WHEN 2 THEN 'stock_??.xlsx' ELSE '*.csv' END AS pattern,
               CASE n_nationkey % 2 WHEN 0 THEN 'sales' ELSE 'inventory' END AS data_type, n_nationkey % 7 <> 3 AS enabled
        FROM nation""",
    "remote_files": """
        SELECT p_partkey % 5 AS connection_id, concat(CASE p_partkey % 3 WHEN 0 THEN 'in/' WHEN 1 THEN 'out/' ELSE '' END, CASE p_partkey % 4 WHEN 0 THEN 'SALES_' WHEN 1 THEN 'stock_' ELSE 'other+' END, p_partkey % 100, CASE p_partkey % 2 WHEN 0 THEN '.CSV' ELSE '.xlsx' END) AS path FROM part WHERE p_partkey <= 300""",
    "taken_files": "SELECT p_partkey % 5 AS connection_id, concat('in/SALES_', p_partkey % 100, '.CSV') AS path FROM part WHERE p_partkey <= 60",
    "inbound_mail": f"""
        SELECT concat('m', c_custkey % 40) AS message_id, CASE WHEN c_custkey % 17 = 0 THEN 'nobody' ELSE concat(c_name, ' <', c_mktsegment, '.', c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '@elsewhere.com>' ELSE '@example.com>' END) END AS sender,
               CASE WHEN c_custkey % 5 = 0 THEN 'inbox@in.example.com' WHEN c_custkey % 11 = 0 THEN concat('reply+', c_custkey % 30, '-0123456789abcdef@in.example.com') ELSE concat('Desk <desk@x.org>, reply+', {_SIGNED}, '@in.example.com') END AS recipient, CASE WHEN c_custkey % 10 = 0 THEN concat('Re: [INV-', {_SIGNED}, '] x') ELSE 'hello' END AS subject,
               concat(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(' text ', c_custkey, chr(13)) END, chr(10), CASE c_custkey % 4 WHEN 0 THEN '> old' WHEN 1 THEN 'On Monday X wrote:' WHEN 2 THEN 'From: a@b.c' ELSE '-- original message --' END, chr(10), 'tail') AS body
        FROM customer WHERE c_custkey <= 600""",
    "mail_cases": "SELECT c_custkey AS id, CAST(1 AS BIGINT) AS tenant_id FROM customer WHERE c_custkey < 25",
    "mail_posted": "SELECT c_custkey AS investigation_id, concat('m', c_custkey) AS message_id FROM customer WHERE c_custkey < 10",
    "comment_users": "SELECT event_id AS comment_id, event_id % 50 AS user_id FROM events WHERE event_type = 'signup' AND event_id % 4 = 0",
    "comment_teams": "SELECT event_id AS comment_id, event_id % 9 AS team_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0",
    "comments": """
        SELECT CAST(1 AS BIGINT) AS tenant_id, event_id AS id, user_id AS author_id, user_id AS investigation_id,
               concat('Please look @Building.', user_id, ' and @furniture.', event_id % 97, ' asap, mail x@y') AS body
        FROM events WHERE event_type = 'signup'""",
}


def _needs(name: str, found: dict[str, None]) -> None:
    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", VIEWS[name])):
        if word in VIEWS:
            _needs(word, found)
    found.setdefault(name)


def prelude(sql: str) -> str:
    """``sql`` with the canonical tables it names defined before it."""
    found: dict[str, None] = {}
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            _needs(name, found)
    if not found:
        return sql
    heads = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in found)
    sql = sql.strip()
    return f"WITH {heads}{', ' + sql[5:] if sql[:5].upper() == 'WITH ' else chr(10) + sql}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical table over the Parquet files of ``sf_dir``."""
    sql, frames = VIEWS[name], {}
    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)):
        frames[word] = load(spark, sf_dir, word) if word in VIEWS else spark.read.parquet(f"{sf_dir}/{word}.parquet")
    sql = re.sub(r"(FROM|JOIN)(\s+)(\w+)", r"\1\2{\3}", sql)
    return spark.sql(sql, **frames)


def context(spark: SparkSession, sf_dir: str, thresholds: dict[str, dict[str, float]] | None = None, **renamed: str) -> Context:
    """The canonical tables for tenant 1; ``renamed`` lets one canonical name stand for another table, as products="part_products"."""
    names = {name: name for name in VIEWS} | renamed
    tables = {name: (lambda view=view: load(spark, sf_dir, view)) for name, view in names.items()}
    tables |= {name: (lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet")) for name in SOURCES if name not in tables}
    return Context(tables, AS_OF, NOW, 1, thresholds or {})
