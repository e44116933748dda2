"""The 27 detection rules.

Each rule takes a Context and returns its detections: sku, store_id (null
where the rule has none), severity and the figures that led to it. ``detect``
brings any of them to one schema with the figures as a JSON context.

Recent windows have a lower bound only; comparison windows include both ends,
so that the day between them counts in both. Ties are broken by the smallest
id or, without one, by the remaining key in order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import impact_severity, ratio
from ..functions.ranges import interval_join, pruned
from ..schema import RULES, SENSITIVITY
from . import baselines



def _null_store() -> Column:
    return F.lit(None).cast("long").alias("store_id")


def _null_sku() -> Column:
    return F.lit(None).cast("string").alias("sku")


def prices(ctx: Context) -> DataFrame:
    """sku and price: what it sells for, else what it costs, else nothing."""
    return ctx.table("products").select("sku", F.coalesce("selling_price", "unit_cost", F.lit(0.0)).cast("double").alias("price"))


def compare_sales(ctx: Context, days: int) -> DataFrame:
    """Units of each SKU in the last ``days`` and in the 28 days before; ``in_recent`` and ``in_before`` tell which windows have rows."""
    q, date = F.col("quantity").cast("double"), F.col("date")
    recent, before = date >= ctx.day(days), date.between(ctx.day(days + 28), ctx.day(days))
    rows = ctx.table("sales").where(date >= ctx.day(days + 28))
    return rows.groupBy("sku").agg(
        F.coalesce(F.sum(F.when(recent, q)), F.lit(0.0)).alias("recent_qty"),
        F.coalesce(F.sum(F.when(before, q)), F.lit(0.0)).alias("before_qty"),
        F.max(recent).alias("in_recent"),
        F.max(before).alias("in_before"),
    )


def _periods(days: int) -> int:
    return max(1, int(28 / days + 0.5))


def _baseline(ctx: Context, stats: DataFrame, rule: str) -> DataFrame:
    """Statistics with the SKU's sensitivity, 2.0 where no feedback has raised it."""
    if "sensitivity" not in ctx.tables:
        return stats.withColumn("sensitivity", F.lit(SENSITIVITY))
    raised = ctx.table("sensitivity").where(F.col("rule_type") == rule).select("sku", F.col("sensitivity_multiplier").alias("sensitivity"))
    return stats.join(raised, "sku", "left").withColumn("sensitivity", F.coalesce("sensitivity", F.lit(SENSITIVITY)))


def _sales_change(ctx: Context, rule: str, rising: bool) -> DataFrame:
    days = int(ctx.threshold(rule, "days"))
    rows = compare_sales(ctx, days).where("in_recent AND before_qty > 0" if rising else "in_before AND before_qty > 0")
    rows = rows.join(_baseline(ctx, baselines.daily_sales(ctx), rule), "sku", "left").join(prices(ctx), "sku", "left")
    daily, usual, price = F.col("recent_qty") / days, F.col("before_qty") / _periods(days), F.coalesce("price", F.lit(0.0))
    sign = 1 if rising else -1
    z = sign * (daily - F.col("mean")) / F.greatest(F.lit(0.001), F.col("stddev"))
    change = sign * (F.col("recent_qty") - usual) / usual * 100
    known = F.col("mean").isNotNull()
    hit = F.when(known, z > F.col("sensitivity")).otherwise(change >= ctx.threshold(rule, "pct"))
    units = F.when(known, F.greatest(F.lit(0.0), sign * (daily - F.col("mean"))) * days).otherwise(sign * (F.col("recent_qty") - usual))
    impact = F.abs(units) * price
    out = rows.where(hit).withColumns({"impact": impact, "z": F.when(known, z), "change_pct": F.when(~known, change), "avg_qty": usual})
    out = out.where(F.col("impact") >= ctx.threshold(rule, "min_revenue"))
    return out.select("sku", _null_store(), impact_severity(F.col("impact")).alias("severity"), "recent_qty", "avg_qty", F.col("mean").alias("baseline_mean"), F.col("z").alias("z_score"), "change_pct", F.col("impact").alias("revenue_impact"))


def sales_spike(ctx: Context) -> DataFrame:
    return _sales_change(ctx, "sales_spike", True)


def sales_drop(ctx: Context) -> DataFrame:
    return _sales_change(ctx, "sales_drop", False)


def demand_seasonality_breach(ctx: Context) -> DataFrame:
    """The last 30 days against the same days a year ago."""
    year = F.add_months(ctx.day(), -12)
    date, q = F.col("date"), F.col("quantity").cast("double")
    now, then = date.between(ctx.day(30), ctx.day()), date.between(F.date_sub(year, 30), year)
    rows = ctx.table("sales").where(now | then).groupBy("sku").agg(F.sum(F.when(now, q)).alias("current_qty"), F.sum(F.when(then, q)).alias("prior_year_qty"))
    change = (F.col("current_qty") - F.col("prior_year_qty")) / F.col("prior_year_qty") * 100
    rows = rows.where("current_qty IS NOT NULL AND prior_year_qty > 0").withColumn("change_pct", change).where(F.abs("change_pct") >= ctx.threshold("demand_seasonality_breach", "pct"))
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "current_qty", "prior_year_qty", "change_pct", F.when(F.col("change_pct") > 0, "above").otherwise("below").alias("direction"))


def cannibalization_signal(ctx: Context) -> DataFrame:
    """A falling SKU with the rising ones of its category."""
    pct, days = ctx.threshold("cannibalization_signal", "pct"), int(ctx.threshold("cannibalization_signal", "days"))
    rows = compare_sales(ctx, days).where("in_before AND before_qty > 0").join(ctx.table("products").select("sku", "category"), "sku")
    usual = F.col("before_qty") / _periods(days)
    rows = rows.withColumn("change_pct", (F.col("recent_qty") - usual) / usual * 100)
    rising = rows.where(F.col("change_pct") >= pct).groupBy("category").agg(F.sort_array(F.collect_list("sku")).alias("rising_skus"))
    falling = rows.where(F.col("change_pct") <= -pct).join(rising, "category")
    return falling.select("sku", _null_store(), F.lit("medium").alias("severity"), "category", "change_pct", F.array_join("rising_skus", ",").alias("rising_skus"))


def return_rate_spike(ctx: Context) -> DataFrame:
    since = F.col("date") >= ctx.day(int(ctx.threshold("return_rate_spike", "days")))
    q = F.col("quantity").cast("double")
    sold = ctx.table("net_sales" if "net_sales" in ctx.tables else "sales").where(since).groupBy("sku").agg(F.coalesce(F.sum(F.when(q > 0, q)), F.lit(0.0)).alias("s"), F.abs(F.coalesce(F.sum(F.when(q < 0, q)), F.lit(0.0))).alias("n"))
    back = ctx.table("returns").where(since).groupBy("sku").agg(F.sum(q).alias("r"))
    rows = sold.join(back, "sku", "full_outer").select("sku", F.coalesce("s", F.lit(0.0)).alias("sales_qty"), (F.coalesce("n", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("returns_qty"))
    rows = rows.where("sales_qty > 0 AND returns_qty > 0").withColumn("return_rate_pct", F.col("returns_qty") / (F.col("sales_qty") + F.col("returns_qty")) * 100)
    return rows.where(F.col("return_rate_pct") >= ctx.threshold("return_rate_spike", "pct")).select("sku", _null_store(), F.lit("medium").alias("severity"), "sales_qty", "returns_qty", "return_rate_pct")


def channel_mix_shift(ctx: Context) -> DataFrame:
    date, q = F.col("date"), F.col("quantity").cast("double")
    now, then = date >= ctx.day(30), date.between(ctx.day(60), ctx.day(30))
    rows = ctx.table("sales").where((date >= ctx.day(60)) & F.col("location").isNotNull()).groupBy("location").agg(F.sum(F.when(now, q)).alias("now"), F.sum(F.when(then, q)).alias("then"))
    total = rows.agg(F.sum("now").alias("all_now"), F.sum("then").alias("all_then"))  # one row
    rows = rows.crossJoin(F.broadcast(total)).where("now IS NOT NULL AND then IS NOT NULL AND all_now > 0 AND all_then > 0")
    rows = rows.withColumns({"recent_share_pct": F.col("now") / F.col("all_now") * 100, "prior_share_pct": F.col("then") / F.col("all_then") * 100}).withColumn("shift_pct", F.col("recent_share_pct") - F.col("prior_share_pct"))
    return rows.where(F.abs("shift_pct") >= ctx.threshold("channel_mix_shift", "pct")).select(_null_sku(), _null_store(), F.lit("medium").alias("severity"), "location", "recent_share_pct", "prior_share_pct", "shift_pct")


def _low_stock(ctx: Context, share: float) -> DataFrame:
    rows = ctx.table("inventory").where(F.col("reorder_point") > 0)
    level = F.col("reorder_point") * share
    return rows.where(F.col("on_hand_qty") <= level if share == 1 else F.col("on_hand_qty") < level)


def stockout_risk(ctx: Context) -> DataFrame:
    return _low_stock(ctx, 1).select("sku", "store_id", F.lit("high").alias("severity"), "location", "on_hand_qty", "reorder_point")


def safety_stock_breach(ctx: Context) -> DataFrame:
    return _low_stock(ctx, 0.5).select("sku", "store_id", F.lit("high").alias("severity"), "location", "on_hand_qty", "reorder_point", (F.col("reorder_point") * 0.5).alias("safety_stock_proxy"))


def _stocked(ctx: Context, order: list[Column]) -> DataFrame:
    """One row with stock for each SKU."""
    first = F.row_number().over(Window.partitionBy("sku").orderBy(*order))
    return ctx.table("inventory").where("on_hand_qty > 0").withColumn("_r", first).where("_r = 1").drop("_r")


def _sold(ctx: Context, days: int | None = None) -> DataFrame:
    rows = ctx.table("sales")
    return (rows if days is None else rows.where(F.col("date") >= ctx.day(days))).select("sku").distinct()


def dead_stock(ctx: Context) -> DataFrame:
    days = int(ctx.threshold("dead_stock", "days"))
    rows = _stocked(ctx, [F.col("id")]).join(_sold(ctx, days), "sku", "left_anti")
    return rows.select("sku", "store_id", F.lit("low").alias("severity"), "on_hand_qty", F.lit(days).cast("long").alias("days_without_sales"))


def phantom_inventory(ctx: Context) -> DataFrame:
    rows = _stocked(ctx, [F.desc("on_hand_qty"), F.col("id")]).join(_sold(ctx), "sku", "left_anti")
    return rows.select("sku", "store_id", F.lit("medium").alias("severity"), "on_hand_qty", "location")


def multi_location_imbalance(ctx: Context) -> DataFrame:
    rows = ctx.table("inventory").where("location IS NOT NULL")
    out = (F.col("on_hand_qty") <= 0) | (F.col("reorder_point").isNotNull() & (F.col("on_hand_qty") <= F.col("reorder_point")))
    over = F.col("reorder_point").isNotNull() & (F.col("on_hand_qty") > 2 * F.col("reorder_point"))
    row = F.struct("location", "on_hand_qty", "reorder_point")
    rows = rows.groupBy("sku").agg(F.count("*").alias("n"), F.min_by(row, F.when(out, F.col("id"))).alias("low"), F.min_by(row, F.when(over, F.col("id"))).alias("high"))
    return rows.where("n >= 2 AND low IS NOT NULL AND high IS NOT NULL").select(
        "sku", _null_store(), F.lit("medium").alias("severity"), F.col("low.location").alias("stocked_out_location"), F.col("high.location").alias("overstocked_location"), F.col("low.on_hand_qty").alias("stocked_out_qty"), (F.col("high.on_hand_qty") - F.col("high.reorder_point")).alias("surplus_qty")
    )


def reorder_point_staleness(ctx: Context) -> DataFrame:
    rows = ctx.table("inventory").where((F.col("reorder_point") > 0) & (F.col("as_of_date") < ctx.day(int(ctx.threshold("reorder_point_staleness", "days")))))
    rows = rows.join(_sold(ctx, 30), "sku", "left_semi")
    return rows.select("sku", "store_id", F.lit("low").alias("severity"), "location", "reorder_point", "as_of_date", F.datediff(ctx.day(), "as_of_date").cast("long").alias("days_stale"))


def inventory_shrinkage(ctx: Context) -> DataFrame:
    """Fall between the two latest snapshots that the SKU's sales, at all locations, don't explain."""
    w = Window.partitionBy("sku", "location").orderBy(F.desc_nulls_first("as_of_date"), F.desc("id"))
    two = ctx.table("inventory").where("location IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("_r") == r, F.col(c))).alias(f"{c}{r}")
    pairs = two.groupBy("sku", "location").agg(*(pick(c, r) for c in ("on_hand_qty", "as_of_date", "store_id") for r in (1, 2)))
    pairs = pairs.where("on_hand_qty2 > 0 AND on_hand_qty1 < on_hand_qty2")
    spans = pairs.select("sku", "location", "as_of_date1", "as_of_date2")
    daily = pruned(ctx.table("sales"), spans, "as_of_date2", "as_of_date1", "date").groupBy("sku", "date").agg(F.sum("quantity").alias("q"))
    sold = interval_join(spans, daily, "sku", "as_of_date2", "as_of_date1", "date").groupBy("sku", "location").agg(F.sum("q").cast("double").alias("sold"))
    rows = pairs.join(sold, ["sku", "location"], "left").withColumns({"prev_qty": F.col("on_hand_qty2").cast("double"), "latest_qty": F.col("on_hand_qty1").cast("double"), "sales_in_period": F.coalesce("sold", F.lit(0.0))})
    rows = rows.withColumn("unexplained", F.col("prev_qty") - F.col("sales_in_period") - F.col("latest_qty")).withColumn("shrinkage_pct", F.col("unexplained") / F.col("prev_qty") * 100)
    rows = rows.where((F.col("unexplained") > 0) & (F.col("shrinkage_pct") >= ctx.threshold("inventory_shrinkage", "pct")))
    return rows.select("sku", F.col("store_id1").alias("store_id"), F.lit("high").alias("severity"), "location", "prev_qty", "latest_qty", "sales_in_period", "unexplained", "shrinkage_pct")


def po_overdue(ctx: Context) -> DataFrame:
    rows = ctx.table("purchase_orders").where((F.col("expected_date") < ctx.day()) & F.col("received_date").isNull() & (F.col("qty_received") < F.col("qty_ordered")))
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "po_number", "supplier", F.datediff(ctx.day(), "expected_date").cast("long").alias("days_overdue"), "qty_ordered", "qty_received")


def receiving_discrepancy(ctx: Context) -> DataFrame:
    """A null received quantity counts as nothing received."""
    got = F.coalesce(F.col("qty_received").cast("double"), F.lit(0.0))
    short = got < F.col("qty_ordered").cast("double") * (1 - ctx.threshold("receiving_discrepancy", "pct") / 100)
    rows = ctx.table("purchase_orders").where(F.col("received_date").isNotNull() & (F.col("qty_ordered") > 0) & short)
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "po_number", "supplier", "qty_ordered", got.alias("qty_received"), ratio(got, F.col("qty_ordered"), 100).alias("received_pct"))


def supplier_lead_time_drift(ctx: Context) -> DataFrame:
    ordered, lead = F.col("order_date"), F.datediff("received_date", "order_date")
    recent, prior = ordered >= ctx.day(90), ordered.between(ctx.day(180), ctx.day(90))
    rows = ctx.table("purchase_orders").where((ordered >= ctx.day(180)) & F.col("received_date").isNotNull())
    rows = rows.groupBy("supplier").agg(F.avg(F.when(recent, lead)).alias("recent_avg_days"), F.avg(F.when(prior, lead)).alias("prior_avg_days"))
    rows = rows.where("recent_avg_days IS NOT NULL AND prior_avg_days > 0").withColumn("drift_pct", (F.col("recent_avg_days") - F.col("prior_avg_days")) / F.col("prior_avg_days") * 100)
    return rows.where(F.col("drift_pct") >= ctx.threshold("supplier_lead_time_drift", "pct")).select(_null_sku(), _null_store(), F.lit("medium").alias("severity"), "supplier", "recent_avg_days", "prior_avg_days", "drift_pct")


def cost_spike(ctx: Context) -> DataFrame:
    """The latest order's cost against the average of all others."""
    rows = ctx.table("purchase_orders").where("unit_cost > 0")
    last = F.struct("order_date", "po_number", F.col("unit_cost").cast("double").alias("cost"), "supplier")
    rows = rows.groupBy("sku").agg(F.max(last).alias("l"), F.sum(F.col("unit_cost").cast("double")).alias("all"), F.count("*").alias("n")).where("n >= 2")
    rows = rows.withColumn("historical_avg", (F.col("all") - F.col("l.cost")) / (F.col("n") - 1)).withColumn("spike_pct", (F.col("l.cost") - F.col("historical_avg")) / F.col("historical_avg") * 100)
    return rows.where(F.col("spike_pct") >= ctx.threshold("cost_spike", "pct")).select("sku", _null_store(), F.lit("high").alias("severity"), F.col("l.supplier").alias("supplier"), F.col("l.po_number").alias("po_number"), F.col("l.cost").alias("latest_cost"), "historical_avg", "spike_pct")


def price_anomaly(ctx: Context) -> DataFrame:
    """Recent prices far from the baseline, or from the average of all priced sales of a SKU with three of them."""
    priced = ctx.table("sales").where("unit_price > 0")
    usual = priced.groupBy("sku").agg(F.avg("unit_price").alias("avg_price"), F.count("*").alias("n")).where("n >= 3")
    recent = priced.where(F.col("date") >= ctx.day(30)).join(usual, "sku").join(_baseline(ctx, baselines.unit_price(ctx), "price_anomaly"), "sku", "left")
    z = F.abs(F.col("unit_price") - F.col("mean")) / F.greatest(F.lit(0.001), F.col("stddev"))
    off = F.abs(F.col("unit_price") - F.col("avg_price")) / F.col("avg_price") * 100
    deviation = F.when(F.col("mean").isNotNull(), z).otherwise(off)
    hit = F.when(F.col("mean").isNotNull(), z > F.col("sensitivity")).otherwise(off >= ctx.threshold("price_anomaly", "pct"))
    worst = F.max(F.struct("deviation", F.col("unit_price"), F.col("store_id"))).alias("w")
    rows = recent.withColumn("deviation", deviation).where(hit).groupBy("sku").agg(worst, F.count("*").alias("count"), F.first("avg_price").alias("avg_price"), F.first("mean").alias("baseline_mean"))
    return rows.select("sku", F.col("w.store_id").alias("store_id"), F.lit("low").alias("severity"), F.col("w.unit_price").alias("worst_price"), F.col("w.deviation").alias("deviation"), "count", "avg_price", "baseline_mean")


def margin_erosion(ctx: Context) -> DataFrame:
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(30)) & (F.col("unit_price") > 0)).join(ctx.table("products").select("sku", "unit_cost"), "sku").where("unit_price < unit_cost")
    rows = rows.groupBy("sku").agg(F.min(F.struct("unit_price", "store_id")).alias("w"), F.first("unit_cost").alias("unit_cost"), F.count("*").alias("count"))
    return rows.select("sku", F.col("w.store_id").alias("store_id"), F.lit("high").alias("severity"), "unit_cost", F.col("w.unit_price").alias("worst_sale_price"), "count")


def discount_signal(ctx: Context) -> DataFrame:
    rows = ctx.table("products").where("selling_price > 0 AND unit_cost > 0 AND selling_price < unit_cost")
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "selling_price", "unit_cost", ((F.col("unit_cost") - F.col("selling_price")) / F.col("unit_cost") * 100).alias("loss_pct"))


def revenue_concentration_risk(ctx: Context) -> DataFrame:
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(int(ctx.threshold("revenue_concentration_risk", "days")))) & (F.col("total_amount") > 0))
    rows = rows.groupBy("sku").agg(F.sum("total_amount").alias("revenue"))
    top = rows.orderBy(F.desc("revenue"), "sku").limit(3).agg(F.sum("revenue").alias("top"), F.array_join(F.sort_array(F.collect_list("sku")), ",").alias("top_skus"))
    whole = top.crossJoin(rows.agg(F.sum("revenue").alias("whole"))).where("whole > 0")  # two rows of one
    whole = whole.withColumn("concentration_pct", ratio(F.col("top"), F.col("whole"), 100)).where(F.col("concentration_pct") >= ctx.threshold("revenue_concentration_risk", "pct"))
    return whole.select(_null_sku(), _null_store(), F.lit("medium").alias("severity"), "top_skus", "concentration_pct", F.col("top").cast("double").alias("top_revenue"), F.col("whole").cast("double").alias("total_revenue"))


def slow_moving_capital(ctx: Context) -> DataFrame:
    days = int(ctx.threshold("slow_moving_capital", "days"))
    stock = ctx.table("inventory").where("on_hand_qty > 0").groupBy("sku").agg(F.sum("on_hand_qty").cast("double").alias("on_hand_qty"))
    rows = stock.join(ctx.table("products").where("unit_cost > 0").select("sku", "unit_cost"), "sku").withColumn("inventory_value", F.col("on_hand_qty") * F.col("unit_cost"))
    rows = rows.where(F.col("inventory_value") >= ctx.threshold("slow_moving_capital", "value")).join(_sold(ctx, days), "sku", "left_anti")
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "on_hand_qty", "unit_cost", "inventory_value", F.lit(days).cast("long").alias("days_without_sales"))


def store_outlier(ctx: Context) -> DataFrame:
    """Locations that sell less of a SKU than usual, or than its other locations on average; one row for each location."""
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(int(ctx.threshold("store_outlier", "days")))) & F.col("location").isNotNull())
    rows = rows.groupBy("sku", "location").agg(F.sum("quantity").cast("double").alias("location_qty"))
    w = Window.partitionBy("sku")
    rows = rows.withColumns({"avg_qty": F.avg("location_qty").over(w), "locations": F.count("*").over(w)}).where("locations >= 2 AND avg_qty > 0")
    rows = rows.join(_baseline(ctx, baselines.location_quantity(ctx), "store_outlier"), "sku", "left")
    z = (F.col("mean") - F.col("location_qty")) / F.greatest(F.lit(0.001), F.col("stddev"))
    drop = (F.col("avg_qty") - F.col("location_qty")) / F.col("avg_qty") * 100
    known = F.col("mean").isNotNull()
    rows = rows.where(F.when(known, z > F.col("sensitivity")).otherwise(drop >= ctx.threshold("store_outlier", "pct")))
    return rows.select("sku", _null_store(), F.lit("medium").alias("severity"), "location", "location_qty", "avg_qty", F.col("mean").alias("baseline_mean"), F.when(known, z).alias("z_score"), F.when(~known, drop).alias("drop_pct"))


def import_frequency_gap(ctx: Context) -> DataFrame:
    """One row if no import has completed for so many days, or ever."""
    days = int(ctx.threshold("import_frequency_gap", "days"))
    last = ctx.table("runs").where(F.col("status").isin("completed", "partial")).agg(F.max("completed_at").alias("last_import_at"))
    gap = F.floor((F.unix_micros(ctx.clock().cast("timestamp")) - F.unix_micros(F.col("last_import_at").cast("timestamp"))) / F.lit(86400e6)).cast("long")
    rows = last.withColumn("days_since_last_import", gap).where(F.col("last_import_at").isNull() | (F.col("days_since_last_import") >= days))
    return rows.select(_null_sku(), _null_store(), F.lit("medium").alias("severity"), "days_since_last_import", F.lit(days).cast("long").alias("days_threshold"))


def duplicate_transaction_ids(ctx: Context) -> DataFrame:
    rows = ctx.table("sales").where("transaction_id IS NOT NULL").groupBy("transaction_id").agg(F.count("*").alias("count"), F.min("sku").alias("sku")).where("count > 1")
    return rows.select("sku", _null_store(), F.lit("high").alias("severity"), "transaction_id", "count")


def sku_master_drift(ctx: Context) -> DataFrame:
    seen = ctx.table("sales").select("sku").distinct().withColumn("found", F.lit("sales")).unionByName(ctx.table("inventory").select("sku").distinct().withColumn("found", F.lit("inventory")))
    rows = seen.where("sku IS NOT NULL").join(ctx.table("products").select("sku"), "sku", "left_anti").groupBy("sku").agg(F.array_join(F.sort_array(F.collect_set("found")), ",").alias("found_in"))
    return rows.select("sku", _null_store(), F.lit("low").alias("severity"), "found_in")


def location_proliferation(ctx: Context) -> DataFrame:
    rows = ctx.table("stores").where((F.col("created_at") >= ctx.day(int(ctx.threshold("location_proliferation", "days")))) & F.col("code").isNull() & F.col("city").isNull() & F.col("address").isNull())
    return rows.select(_null_sku(), F.col("id").alias("store_id"), F.lit("low").alias("severity"), F.col("name").alias("store_name"), F.col("created_at").cast("date").alias("created_at"))


REGISTRY: dict[str, Callable[[Context], DataFrame]] = {name: globals()[name] for name in RULES}


COLUMNS = "tenant_id long, rule_type string, severity string, sku string, store_id long, revenue_impact double, context string"


def _uniform(ctx: Context, name: str, rows: DataFrame) -> DataFrame:
    """Detections of a rule in the one schema; what is particular to it is JSON."""
    figures = [c for c in rows.columns if c not in ("sku", "store_id", "severity")]
    impact = F.col("revenue_impact").cast("double") if "revenue_impact" in figures else F.lit(None).cast("double")
    return rows.select(
        F.lit(ctx.tenant_id).cast("long").alias("tenant_id"), F.lit(name).alias("rule_type"), "severity", F.col("sku").cast("string").alias("sku"), F.col("store_id").cast("long").alias("store_id"), impact.alias("revenue_impact"), F.to_json(F.struct(*figures)).alias("context")
    )


def enabled(ctx: Context) -> list[str]:
    """Rules that the tenant has not switched off (settings: rule_type, enabled); without settings all. One row a rule at most."""
    if "rule_settings" not in ctx.tables:
        return list(REGISTRY)
    off = {r["rule_type"] for r in ctx.table("rule_settings").where("NOT enabled").select("rule_type").distinct().limit(len(REGISTRY)).collect()}
    return [name for name in REGISTRY if name not in off]


def detect(ctx: Context, names: list[str] | None = None, extra: dict[str, Callable[[Context], DataFrame]] | None = None) -> DataFrame:
    """Detections of all enabled rules, or of ``names`` and ``extra`` ones, in one schema."""
    rules = {n: REGISTRY[n] for n in (enabled(ctx) if names is None else names)} | (extra or {})
    out = ctx.table("sales").sparkSession.createDataFrame([], COLUMNS)
    for name, rule in rules.items():
        out = out.unionByName(_uniform(ctx, name, rule(ctx)))
    return out


def run(ctx: Context, write: Callable[[str, DataFrame], None], names: list[str] | None = None, extra: dict[str, Callable[[Context], DataFrame]] | None = None) -> dict[str, str]:
    """Each rule in a job of its own, its detections handed to ``write``; a rule that fails leaves the others alone. Returns the errors by rule."""
    rules, failed = {n: REGISTRY[n] for n in (enabled(ctx) if names is None else names)} | (extra or {}), {}
    for name, rule in rules.items():
        try:
            write(name, _uniform(ctx, name, rule(ctx)))
        except Exception as e:  # noqa: BLE001  whatever it is, the other rules go on
            failed[name] = str(e)
    return failed


def as_of(ctx: Context, day: dt.date) -> Context:
    """The same tables at another day."""
    return Context(ctx.tables, day, ctx.now, ctx.tenant_id, ctx.thresholds)
