"""Queries and oracle SQL of the baselines and the detection rules over the driver's tables."""

from __future__ import annotations

from ..operators import baselines, rules
from .registry import Catalogue, r

CAT = Catalogue()
T = "DATE '2001-08-01'"
_PART = {"sales": "part_sales", "products": "part_products"}

_DAILY = f"""(SELECT sku, avg(u) AS mean, stddev_pop(u) AS sd, count(*) AS n FROM (SELECT sku, date, CAST(sum(quantity) AS DOUBLE) AS u FROM sales
    WHERE date >= {T} - 90 AND quantity > 0 AND sku IS NOT NULL GROUP BY sku, date) GROUP BY sku HAVING count(*) >= 7 AND stddev_pop(u) >= 0.001)"""
_STORE = f"""(SELECT sku, store_id, avg(u) AS mean, stddev_pop(u) AS sd, count(*) AS n FROM (SELECT sku, store_id, date, CAST(sum(quantity) AS DOUBLE) AS u FROM sales
    WHERE date >= {T} - 90 AND quantity > 0 AND store_id IS NOT NULL GROUP BY sku, store_id, date) GROUP BY sku, store_id HAVING count(*) >= 7 AND stddev_pop(u) >= 0.001)"""
_PRICE = f"(SELECT sku, avg(unit_price) AS mean, stddev_pop(unit_price) AS sd, count(*) AS n FROM sales WHERE date >= {T} - 90 AND unit_price > 0 GROUP BY sku HAVING count(*) >= 7 AND stddev_pop(unit_price) >= 0.001)"
_PLACE = f"""(SELECT sku, avg(u) AS mean, stddev_pop(u) AS sd, count(*) AS n FROM (SELECT sku, location, CAST(sum(quantity) AS DOUBLE) AS u FROM sales
    WHERE date >= {T} - 90 AND location IS NOT NULL GROUP BY sku, location) GROUP BY sku HAVING count(*) >= 7 AND stddev_pop(u) >= 0.001)"""
_STATS = f"{r('mean')} AS mean, {r('sd')} AS stddev, n AS sample_count"


def _compare(days: int) -> str:
    return f"""(SELECT sku, coalesce(sum(CASE WHEN date >= {T} - {days} THEN CAST(quantity AS DOUBLE) END), 0) AS recent, coalesce(sum(CASE WHEN date BETWEEN {T} - {days + 28} AND {T} - {days} THEN CAST(quantity AS DOUBLE) END), 0) AS before,
    max(CASE WHEN date >= {T} - {days} THEN 1 ELSE 0 END) AS in_recent, max(CASE WHEN date BETWEEN {T} - {days + 28} AND {T} - {days} THEN 1 ELSE 0 END) AS in_before FROM sales WHERE date >= {T} - {days + 28} GROUP BY sku)"""


CAT.add("baseline_daily_sales", baselines.daily_sales, f"SELECT sku, {_STATS} FROM {_DAILY}")
CAT.add("baseline_daily_sales_store", lambda c: baselines.daily_sales(c, True), f"SELECT sku, store_id, {_STATS} FROM {_STORE}")
CAT.add("baseline_daily_sales_store_category", lambda c: baselines.daily_sales(c, True), f"SELECT sku, store_id, {_STATS} FROM {_STORE.replace('FROM sales', 'FROM brand_sales')}", sales="brand_sales")
def _merged(c):
    """Old rows of prices, half of them with new statistics, and new rows of daily sales."""
    from pyspark.sql import functions as F

    price = baselines.compute(c).where("metric = 'unit_price'")
    old = price.withColumns({"mean": F.lit(1.0), "stddev": F.lit(1.0), "sample_count": F.lit(7).cast("long"), "sensitivity_multiplier": F.lit(3.0), "fp_count": F.lit(5).cast("long")})
    new = price.where("length(sku) % 2 = 0").unionByName(baselines.compute(c).where("metric = 'location_qty'"))
    return baselines.merge(old, new).select("metric", "sku", "mean", "sample_count", "sensitivity_multiplier", "fp_count")


CAT.add(
    "baseline_merge",
    _merged,
    f"SELECT 'unit_price' AS metric, sku, {r('CASE WHEN length(sku) % 2 = 0 THEN mean ELSE 1 END')} AS mean, CASE WHEN length(sku) % 2 = 0 THEN n ELSE 7 END AS sample_count, 3.0::DOUBLE AS sensitivity_multiplier, 5 AS fp_count FROM {_PRICE} UNION ALL SELECT 'location_qty', sku, {r('mean')}, n, 2.0::DOUBLE, 0 FROM {_PLACE}",
)
CAT.add("baseline_unit_price", baselines.unit_price, f"SELECT sku, {_STATS} FROM {_PRICE}")
CAT.add("baseline_location_qty", baselines.location_quantity, f"SELECT sku, {_STATS} FROM {_PLACE}")
CAT.add(
    "baseline_all",
    baselines.compute,
    f"""SELECT rule_type, 'daily_qty' AS metric, sku, NULL::BIGINT AS store_id, {_STATS} FROM {_DAILY}, (SELECT unnest(['sales_spike', 'sales_drop']) AS rule_type)
    UNION ALL SELECT rule_type, 'daily_qty', sku, store_id, {_STATS} FROM {_STORE}, (SELECT unnest(['sales_spike', 'sales_drop']) AS rule_type)
    UNION ALL SELECT 'price_anomaly', 'unit_price', sku, NULL, {_STATS} FROM {_PRICE} UNION ALL SELECT 'store_outlier', 'location_qty', sku, NULL, {_STATS} FROM {_PLACE}""",
)
CAT.add(
    "baseline_lookup_fallback",
    lambda c: baselines.lookup(c.table("sales").select("sku", "store_id").distinct(), baselines.daily_sales(c, True), baselines.daily_sales(c)),
    f"""SELECT k.sku, k.store_id, {r('coalesce(s.mean, w.mean)')} AS mean, {r('coalesce(s.sd, w.sd)')} AS stddev, coalesce(s.n, w.n) AS sample_count, CASE WHEN s.mean IS NOT NULL THEN 'store' WHEN w.mean IS NOT NULL THEN 'retailer' END AS scope
    FROM (SELECT DISTINCT sku, store_id FROM sales) k LEFT JOIN {_STORE} s ON k.sku = s.sku AND k.store_id = s.store_id LEFT JOIN {_DAILY} w ON k.sku = w.sku""",
)
CAT.add("fp_feedback", baselines.false_positive_feedback, f"SELECT rule_type, sku, count(*) AS fp_count, {r('least(5.0, 2.0 + 0.2 * count(*))')} AS sensitivity_multiplier FROM anomalies WHERE is_false_positive AND sku IS NOT NULL GROUP BY rule_type, sku")
CAT.add(
    "baseline_z_scores",
    lambda c: c.table("sales").groupBy("sku", "date").agg({"quantity": "sum"}).withColumnRenamed("sum(quantity)", "units").join(baselines.daily_sales(c), "sku").selectExpr("sku", "date", "cast(units as double) AS units", "mean", "stddev").withColumn("z", baselines.z_score(_col("units"), _col("mean"), _col("stddev"))).select("sku", "date", "units", "z"),
    f"SELECT s.sku, s.date, {r('s.u')} AS units, {r('(s.u - b.mean) / b.sd')} AS z FROM (SELECT sku, date, CAST(sum(quantity) AS DOUBLE) AS u FROM sales GROUP BY sku, date) s JOIN {_DAILY} b ON s.sku = b.sku",
)


def _col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def _change(rising: bool, pct: float) -> str:
    sign, gate = (1, "in_recent = 1") if rising else (-1, "in_before = 1")
    return f"""SELECT sku, NULL::BIGINT AS store_id, CASE WHEN impact >= 10000 THEN 'high' WHEN impact >= 2000 THEN 'medium' ELSE 'low' END AS severity, {r('recent')} AS recent_qty, {r('usual')} AS avg_qty, {r('mean')} AS baseline_mean,
        {r('CASE WHEN mean IS NOT NULL THEN z END')} AS z_score, {r('CASE WHEN mean IS NULL THEN change END')} AS change_pct, {r('impact')} AS revenue_impact
    FROM (SELECT *, abs(CASE WHEN mean IS NOT NULL THEN greatest(0.0, {sign} * (daily - mean)) * 7 ELSE {sign} * (recent - usual) END) * price AS impact
      FROM (SELECT c.sku, recent, recent / 7 AS daily, before / 4 AS usual, mean, {sign} * (recent / 7 - mean) / greatest(0.001, sd) AS z, {sign} * (recent - before / 4) / (before / 4) * 100 AS change, coalesce(p.selling_price, p.unit_cost, 0) AS price
        FROM {_compare(7)} c LEFT JOIN {_DAILY} b ON c.sku = b.sku LEFT JOIN products p ON c.sku = p.sku WHERE {gate} AND before > 0)
      WHERE CASE WHEN mean IS NOT NULL THEN z > 2.0 ELSE change >= {pct} END) WHERE impact >= 500"""


_SOLD = "SELECT sku FROM sales WHERE date >= " + T + " - {}"
_MIX = f"""SELECT NULL::VARCHAR AS sku, NULL::BIGINT AS store_id, 'medium' AS severity, location, {r('a')} AS recent_share_pct, {r('b')} AS prior_share_pct, {r('a - b')} AS shift_pct
    FROM (SELECT location, n / sum(n) OVER () * 100 AS a, t / sum(t) OVER () * 100 AS b FROM (SELECT location, sum(CASE WHEN date >= {T} - 30 THEN CAST(quantity AS DOUBLE) END) AS n, sum(CASE WHEN date BETWEEN {T} - 60 AND {T} - 30 THEN CAST(quantity AS DOUBLE) END) AS t
      FROM sales WHERE date >= {T} - 60 AND location IS NOT NULL GROUP BY location)) WHERE a IS NOT NULL AND b IS NOT NULL AND abs(a - b) >= """
_TOP = f"""SELECT NULL::VARCHAR AS sku, NULL::BIGINT AS store_id, 'medium' AS severity, top_skus, {r('top / whole * 100')} AS concentration_pct, {r('top')} AS top_revenue, {r('whole')} AS total_revenue
    FROM (SELECT string_agg(sku, ',' ORDER BY sku) FILTER (WHERE k <= 3) AS top_skus, CAST(sum(rev) FILTER (WHERE k <= 3) AS DOUBLE) AS top, CAST(sum(rev) AS DOUBLE) AS whole
      FROM (SELECT *, row_number() OVER (ORDER BY rev DESC, sku) AS k FROM (SELECT sku, sum(total_amount) AS rev FROM sales WHERE date >= {T} - 90 AND total_amount > 0 GROUP BY sku))) WHERE top / whole * 100 >= """

CAT.add("rule_sales_spike", rules.sales_spike, _change(True, 50))
CAT.add("rule_sales_drop", rules.sales_drop, _change(False, 30))
CAT.add(
    "rule_demand_seasonality_breach",
    rules.demand_seasonality_breach,
    f"""SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, {r('c')} AS current_qty, {r('p')} AS prior_year_qty, {r('(c - p) / p * 100')} AS change_pct, CASE WHEN c > p THEN 'above' ELSE 'below' END AS direction
    FROM (SELECT sku, sum(CASE WHEN date BETWEEN {T} - 30 AND {T} THEN CAST(quantity AS DOUBLE) END) AS c, sum(CASE WHEN date BETWEEN DATE '2000-07-02' AND DATE '2000-08-01' THEN CAST(quantity AS DOUBLE) END) AS p FROM sales GROUP BY sku)
    WHERE c IS NOT NULL AND p > 0 AND abs((c - p) / p * 100) >= 40""",
)
CAT.add(
    "rule_cannibalization_signal",
    rules.cannibalization_signal,
    f"""SELECT f.sku, NULL::BIGINT AS store_id, 'medium' AS severity, f.category, {r('f.change')} AS change_pct, u.list AS rising_skus
    FROM (SELECT c.sku, p.category, (recent - before) / before * 100 AS change FROM {_compare(30)} c JOIN products p ON c.sku = p.sku WHERE in_before = 1 AND before > 0) f
    JOIN (SELECT category, string_agg(sku, ',' ORDER BY sku) AS list FROM (SELECT c.sku, p.category, (recent - before) / before * 100 AS change FROM {_compare(30)} c JOIN products p ON c.sku = p.sku WHERE in_before = 1 AND before > 0) WHERE change >= 30 GROUP BY category) u
      ON f.category = u.category WHERE f.change <= -30""",
)
CAT.add(
    "rule_return_rate_spike",
    rules.return_rate_spike,
    f"""SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, {r('s')} AS sales_qty, {r('n')} AS returns_qty, {r('n / (s + n) * 100')} AS return_rate_pct
    FROM (SELECT coalesce(a.sku, b.sku) AS sku, coalesce(a.s, 0) AS s, coalesce(a.n, 0) + coalesce(b.x, 0) AS n
      FROM (SELECT sku, coalesce(sum(CASE WHEN quantity > 0 THEN CAST(quantity AS DOUBLE) END), 0) AS s, abs(coalesce(sum(CASE WHEN quantity < 0 THEN CAST(quantity AS DOUBLE) END), 0)) AS n FROM net_sales WHERE date >= {T} - 30 GROUP BY sku) a
      FULL JOIN (SELECT sku, sum(CAST(quantity AS DOUBLE)) AS x FROM returns WHERE date >= {T} - 30 GROUP BY sku) b ON a.sku = b.sku) WHERE s > 0 AND n > 0 AND n / (s + n) * 100 >= 15""",
)
CAT.add("rule_channel_mix_shift", rules.channel_mix_shift, _MIX + "25")
CAT.add("rule_channel_mix_shift_pct2", rules.channel_mix_shift, _MIX + "2", thresholds={"channel_mix_shift": {"pct": 2}})
CAT.add("rule_stockout_risk", rules.stockout_risk, f"SELECT sku, store_id, 'high' AS severity, location, {r('on_hand_qty')} AS on_hand_qty, {r('reorder_point')} AS reorder_point FROM inventory WHERE reorder_point > 0 AND on_hand_qty <= reorder_point")
CAT.add("rule_safety_stock_breach", rules.safety_stock_breach, f"SELECT sku, store_id, 'high' AS severity, location, {r('on_hand_qty')} AS on_hand_qty, {r('reorder_point')} AS reorder_point, {r('reorder_point * 0.5')} AS safety_stock_proxy FROM inventory WHERE reorder_point > 0 AND on_hand_qty < 0.5 * reorder_point")
CAT.add(
    "rule_dead_stock",
    rules.dead_stock,
    f"SELECT sku, store_id, 'low' AS severity, {r('on_hand_qty')} AS on_hand_qty, 30::BIGINT AS days_without_sales FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY id) AS k FROM inventory WHERE on_hand_qty > 0) WHERE k = 1 AND sku NOT IN (SELECT sku FROM part_sales WHERE date >= {T} - 30)",
    **_PART,
)
_PHANTOM = f"SELECT sku, store_id, 'medium' AS severity, {r('on_hand_qty')} AS on_hand_qty, location FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY on_hand_qty DESC, id) AS k FROM inventory WHERE on_hand_qty > 0) WHERE k = 1 AND sku NOT IN (SELECT sku FROM {{}})"
CAT.add("rule_phantom_inventory_early", rules.phantom_inventory, _PHANTOM.format("early_sales"), sales="early_sales", products="part_products")
CAT.add(
    "rule_phantom_inventory",
    rules.phantom_inventory,
    f"SELECT sku, store_id, 'medium' AS severity, {r('on_hand_qty')} AS on_hand_qty, location FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY on_hand_qty DESC, id) AS k FROM inventory WHERE on_hand_qty > 0) WHERE k = 1 AND sku NOT IN (SELECT sku FROM part_sales)",
    **_PART,
)
CAT.add(
    "rule_multi_location_imbalance",
    rules.multi_location_imbalance,
    f"""SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, l.location AS stocked_out_location, h.location AS overstocked_location, {r('l.on_hand_qty')} AS stocked_out_qty, {r('h.on_hand_qty - h.reorder_point')} AS surplus_qty
    FROM (SELECT sku, count(*) AS n, min(CASE WHEN on_hand_qty <= 0 OR (reorder_point IS NOT NULL AND on_hand_qty <= reorder_point) THEN id END) AS lo, min(CASE WHEN reorder_point IS NOT NULL AND on_hand_qty > 2 * reorder_point THEN id END) AS hi
      FROM inventory WHERE location IS NOT NULL GROUP BY sku) g JOIN (SELECT id, location, on_hand_qty FROM inventory) l ON l.id = g.lo JOIN (SELECT id, location, on_hand_qty, reorder_point FROM inventory) h ON h.id = g.hi WHERE n >= 2""",
)
CAT.add(
    "rule_reorder_point_staleness",
    rules.reorder_point_staleness,
    f"SELECT sku, store_id, 'low' AS severity, location, {r('reorder_point')} AS reorder_point, as_of_date, date_diff('day', as_of_date, {T}) AS days_stale FROM inventory WHERE reorder_point > 0 AND as_of_date < {T} - 90 AND sku IN (SELECT sku FROM part_sales WHERE date >= {T} - 30)",
    **_PART,
)
CAT.add(
    "rule_inventory_shrinkage",
    rules.inventory_shrinkage,
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY sku, location ORDER BY as_of_date DESC NULLS FIRST, id DESC) AS rn FROM inventory WHERE location IS NOT NULL),
    p AS (SELECT a.sku, a.location, a.store_id, CAST(b.on_hand_qty AS DOUBLE) AS prev, CAST(a.on_hand_qty AS DOUBLE) AS latest, b.as_of_date AS d0, a.as_of_date AS d1 FROM k a JOIN k b ON a.sku = b.sku AND a.location = b.location AND a.rn = 1 AND b.rn = 2 WHERE b.on_hand_qty > 0 AND a.on_hand_qty < b.on_hand_qty),
    s AS (SELECT p.*, coalesce((SELECT sum(CAST(x.quantity AS DOUBLE)) FROM part_sales x WHERE x.sku = p.sku AND x.date BETWEEN p.d0 AND p.d1), 0) AS sold FROM p)
    SELECT sku, store_id, 'high' AS severity, location, {r('prev')} AS prev_qty, {r('latest')} AS latest_qty, {r('sold')} AS sales_in_period, {r('prev - sold - latest')} AS unexplained, {r('(prev - sold - latest) / prev * 100')} AS shrinkage_pct
    FROM s WHERE prev - sold - latest > 0 AND (prev - sold - latest) / prev * 100 >= 20""",
    **_PART,
)
CAT.add(
    "rule_po_overdue",
    rules.po_overdue,
    f"SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, po_number, supplier, date_diff('day', expected_date, {T}) AS days_overdue, {r('qty_ordered')} AS qty_ordered, {r('qty_received')} AS qty_received FROM purchase_orders WHERE expected_date < {T} AND received_date IS NULL AND qty_received < qty_ordered",
)
CAT.add(
    "rule_receiving_discrepancy",
    rules.receiving_discrepancy,
    f"SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, po_number, supplier, {r('qty_ordered')} AS qty_ordered, {r('g')} AS qty_received, {r('g * 100 / CAST(qty_ordered AS DOUBLE)')} AS received_pct FROM (SELECT *, coalesce(CAST(qty_received AS DOUBLE), 0) AS g FROM purchase_orders) WHERE received_date IS NOT NULL AND qty_ordered > 0 AND g < CAST(qty_ordered AS DOUBLE) * CAST(0.8 AS DOUBLE)",
)
CAT.add(
    "rule_supplier_lead_time_drift",
    rules.supplier_lead_time_drift,
    f"""SELECT NULL::VARCHAR AS sku, NULL::BIGINT AS store_id, 'medium' AS severity, supplier, {r('a')} AS recent_avg_days, {r('b')} AS prior_avg_days, {r('(a - b) / b * 100')} AS drift_pct
    FROM (SELECT supplier, avg(CASE WHEN order_date >= {T} - 90 THEN d END) AS a, avg(CASE WHEN order_date BETWEEN {T} - 180 AND {T} - 90 THEN d END) AS b
      FROM (SELECT supplier, order_date, date_diff('day', order_date, received_date) AS d FROM purchase_orders WHERE order_date >= {T} - 180 AND received_date IS NOT NULL) GROUP BY supplier) WHERE a IS NOT NULL AND b > 0 AND (a - b) / b * 100 >= 30""",
)
CAT.add(
    "rule_cost_spike",
    rules.cost_spike,
    f"""SELECT sku, NULL::BIGINT AS store_id, 'high' AS severity, supplier, po_number, {r('cost')} AS latest_cost, {r('h')} AS historical_avg, {r('(cost - h) / h * 100')} AS spike_pct
    FROM (SELECT sku, supplier, po_number, unit_cost AS cost, (t - unit_cost) / (n - 1) AS h FROM (SELECT *, sum(unit_cost) OVER (PARTITION BY sku) AS t, count(*) OVER (PARTITION BY sku) AS n,
      row_number() OVER (PARTITION BY sku ORDER BY order_date DESC, po_number DESC, unit_cost DESC, supplier DESC) AS k FROM purchase_orders WHERE unit_cost > 0) WHERE k = 1 AND n >= 2) WHERE (cost - h) / h * 100 >= 25""",
)
CAT.add(
    "rule_price_anomaly",
    rules.price_anomaly,
    f"""WITH a AS (SELECT sku, avg(unit_price) AS ap FROM sales WHERE unit_price > 0 GROUP BY sku HAVING count(*) >= 3),
    x AS (SELECT s.sku, s.store_id, s.unit_price, a.ap, b.mean, abs(s.unit_price - b.mean) / greatest(0.001, b.sd) AS z, abs(s.unit_price - a.ap) / a.ap * 100 AS off FROM sales s JOIN a ON s.sku = a.sku LEFT JOIN {_PRICE} b ON s.sku = b.sku WHERE s.unit_price > 0 AND s.date >= {T} - 30),
    h AS (SELECT *, CASE WHEN mean IS NOT NULL THEN z ELSE off END AS dev FROM x WHERE CASE WHEN mean IS NOT NULL THEN z > 2.0 ELSE off >= 25 END),
    k AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY dev DESC, unit_price DESC, store_id DESC) AS rn, count(*) OVER (PARTITION BY sku) AS n FROM h)
    SELECT sku, store_id, 'low' AS severity, {r('unit_price')} AS worst_price, {r('dev')} AS deviation, n AS count, {r('ap')} AS avg_price, {r('mean')} AS baseline_mean FROM k WHERE rn = 1""",
)
CAT.add(
    "rule_margin_erosion",
    rules.margin_erosion,
    f"""SELECT sku, store_id, 'high' AS severity, {r('unit_cost')} AS unit_cost, {r('unit_price')} AS worst_sale_price, n AS count FROM (SELECT s.sku, s.store_id, s.unit_price, p.unit_cost, row_number() OVER (PARTITION BY s.sku ORDER BY s.unit_price, s.store_id) AS k, count(*) OVER (PARTITION BY s.sku) AS n
      FROM sales s JOIN products p ON s.sku = p.sku WHERE s.date >= {T} - 30 AND s.unit_price > 0 AND s.unit_price < p.unit_cost) WHERE k = 1""",
)
CAT.add(
    "rule_discount_signal",
    rules.discount_signal,
    f"SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, {r('selling_price')} AS selling_price, {r('unit_cost')} AS unit_cost, {r('(unit_cost - selling_price) / unit_cost * 100')} AS loss_pct FROM part_products WHERE selling_price > 0 AND unit_cost > 0 AND selling_price < unit_cost",
    **_PART,
)
CAT.add("rule_revenue_concentration_risk", rules.revenue_concentration_risk, _TOP + "80")
CAT.add("rule_revenue_concentration_risk_pct2", rules.revenue_concentration_risk, _TOP + "2", thresholds={"revenue_concentration_risk": {"pct": 2}})
CAT.add(
    "rule_slow_moving_capital",
    rules.slow_moving_capital,
    f"SELECT s.sku, NULL::BIGINT AS store_id, 'medium' AS severity, {r('q')} AS on_hand_qty, {r('p.unit_cost')} AS unit_cost, {r('q * p.unit_cost')} AS inventory_value, 60::BIGINT AS days_without_sales FROM (SELECT sku, CAST(sum(on_hand_qty) AS DOUBLE) AS q FROM inventory WHERE on_hand_qty > 0 GROUP BY sku) s JOIN part_products p ON s.sku = p.sku WHERE p.unit_cost > 0 AND q * p.unit_cost >= 1000 AND s.sku NOT IN (SELECT sku FROM part_sales WHERE date >= {T} - 60)",
    **_PART,
)
CAT.add(
    "rule_store_outlier",
    rules.store_outlier,
    f"""SELECT sku, NULL::BIGINT AS store_id, 'medium' AS severity, location, {r('q')} AS location_qty, {r('a')} AS avg_qty, {r('mean')} AS baseline_mean, {r('CASE WHEN mean IS NOT NULL THEN z END')} AS z_score, {r('CASE WHEN mean IS NULL THEN d END')} AS drop_pct
    FROM (SELECT x.*, b.mean, (b.mean - q) / greatest(0.001, b.sd) AS z, (a - q) / a * 100 AS d FROM (SELECT sku, location, q, avg(q) OVER (PARTITION BY sku) AS a, count(*) OVER (PARTITION BY sku) AS places
      FROM (SELECT sku, location, CAST(sum(quantity) AS DOUBLE) AS q FROM sales WHERE date >= {T} - 7 AND location IS NOT NULL GROUP BY sku, location)) x LEFT JOIN {_PLACE} b ON x.sku = b.sku WHERE places >= 2 AND a > 0) WHERE CASE WHEN mean IS NOT NULL THEN z > 2.0 ELSE d >= 50 END""",
)
_GAP = "SELECT NULL::VARCHAR AS sku, NULL::BIGINT AS store_id, 'medium' AS severity, g AS days_since_last_import, {0}::BIGINT AS days_threshold FROM (SELECT CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(completed_at)) / 86400) AS BIGINT) AS g FROM runs WHERE status IN ('completed', 'partial')) WHERE g IS NULL OR g >= {0}"
CAT.add("rule_import_frequency_gap", rules.import_frequency_gap, _GAP.format(7))
CAT.add("rule_import_frequency_gap_days0", rules.import_frequency_gap, _GAP.format(0), thresholds={"import_frequency_gap": {"days": 0}})
CAT.add("rule_duplicate_transaction_ids", rules.duplicate_transaction_ids, "SELECT min(sku) AS sku, NULL::BIGINT AS store_id, 'high' AS severity, transaction_id, count(*) AS count FROM sales WHERE transaction_id IS NOT NULL GROUP BY transaction_id HAVING count(*) > 1")
CAT.add(
    "rule_sku_master_drift",
    rules.sku_master_drift,
    "SELECT sku, NULL::BIGINT AS store_id, 'low' AS severity, string_agg(f, ',' ORDER BY f) AS found_in FROM (SELECT DISTINCT sku, 'sales' AS f FROM part_sales UNION ALL SELECT DISTINCT sku, 'inventory' FROM inventory) WHERE sku IS NOT NULL AND sku NOT IN (SELECT sku FROM part_products) GROUP BY sku",
    **_PART,
)
CAT.add("rule_location_proliferation", rules.location_proliferation, f"SELECT NULL::VARCHAR AS sku, id AS store_id, 'low' AS severity, name AS store_name, CAST(created_at AS DATE) AS created_at FROM stores WHERE created_at >= {T} - 7 AND code IS NULL AND city IS NULL AND address IS NULL")


def _counts(c):
    from pyspark.sql import functions as F

    return rules.detect(c).groupBy("rule_type", "severity").agg(F.count("*").alias("detections"))


_FAMILIES = ["sales_spike", "sales_drop", "demand_seasonality_breach", "cannibalization_signal", "return_rate_spike", "channel_mix_shift", "stockout_risk", "safety_stock_breach", "po_overdue", "receiving_discrepancy", "supplier_lead_time_drift", "cost_spike", "price_anomaly", "margin_erosion", "revenue_concentration_risk", "store_outlier", "import_frequency_gap", "duplicate_transaction_ids", "location_proliferation", "multi_location_imbalance"]


def _all(c):
    from pyspark.sql import functions as F

    c = c.staged("sales", "inventory", "purchase_orders")  # twenty rules scan them
    return rules.detect(c, _FAMILIES).groupBy("rule_type", "severity").agg(F.count("*").alias("detections"))


CAT.add("detections_all", _all, " UNION ALL ".join(f"SELECT '{n}' AS rule_type, severity, count(*) AS detections FROM ({CAT.sql['rule_' + n]}) GROUP BY severity" for n in _FAMILIES))
