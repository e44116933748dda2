"""Evidence that a detection rests on: figures and series of its SKU (and store), and their collection by kind of rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import ratio
from . import baselines


def daily_sales(ctx: Context, days: int = 14) -> DataFrame:
    """Units of each day of a SKU's last ``days`` days, as a JSON object in date order, and their sum."""
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(days)) & (F.col("quantity") > 0)).groupBy("sku", "date").agg(F.sum("quantity").cast("long").alias("q"))
    return rows.groupBy("sku").agg(_series("date", "q").alias("series"), F.sum("q").alias("units"))


def _series(key: str, value: str) -> Column:
    """The group's values by key, as a JSON object in the order of the keys."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value")))))
    return F.to_json(F.map_from_entries(pairs))


def last_day_z(ctx: Context, days: int = 14) -> DataFrame:
    """z of the last selling day against the SKU's own baseline; above it supports, below it contradicts."""
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(days)) & (F.col("quantity") > 0)).groupBy("sku", "date").agg(F.sum("quantity").cast("double").alias("q"))
    rows = rows.groupBy("sku").agg(F.max_by("q", "date").alias("q")).join(baselines.daily_sales(ctx), "sku")
    rows = rows.withColumn("z", baselines.z_score(F.col("q"), F.col("mean"), F.col("stddev")))
    return rows.select("sku", "q", "z", F.when(F.col("z") > 0, "supports").otherwise("contradicts").alias("direction"))


def by_location(ctx: Context, days: int = 30) -> DataFrame:
    return ctx.table("sales").where((F.col("date") >= ctx.day(days)) & F.col("sku").isNotNull()).groupBy("sku", "location").agg(F.sum("quantity").alias("units"))


def returns(ctx: Context, days: int = 30) -> DataFrame:
    """Returned units in the sales table and their rate of gross sales (not of sales and returns together)."""
    q = F.col("quantity")
    rows = ctx.table("sales").where(F.col("date") >= ctx.day(days)).groupBy("sku").agg(F.coalesce(F.sum(F.when(q < 0, F.abs(q))), F.lit(0)).alias("returned"), F.sum(F.when(q > 0, q)).alias("gross"))
    return rows.select("sku", "returned", "gross", ratio(F.col("returned"), F.col("gross"), 100).alias("rate"))


def cover_days(ctx: Context) -> DataFrame:
    """The latest level of each SKU and store, its reorder point, and the days it lasts at the last 30 days' pace."""
    w = Window.partitionBy("sku", "store_id").orderBy(F.desc_nulls_first("as_of_date"), "id")
    level = ctx.table("inventory").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    pace = ctx.table("sales").where((F.col("date") >= ctx.day(30)) & (F.col("quantity") > 0)).groupBy("sku").agg(F.sum("quantity").cast("double").alias("q"))
    cover = F.round(F.col("on_hand_qty").cast("double") / (F.col("q") / 30.0) + 1e-9, 1)
    return level.join(pace, "sku").select("sku", "store_id", "on_hand_qty", "reorder_point", cover.alias("cover_days"), (cover < 7).alias("supports"))


def last_orders(ctx: Context, limit: int = 10) -> DataFrame:
    """The last orders of each SKU, the newest first, as a JSON array."""
    w = Window.partitionBy("sku").orderBy(F.desc_nulls_first("order_date"), F.desc("po_number"), F.desc("unit_cost"))
    rows = ctx.table("purchase_orders").withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return rows.groupBy("sku").agg(_orders().alias("orders"), F.count("*").alias("n"))


def last_orders_of_all(ctx: Context, limit: int = 10) -> DataFrame:
    """The last orders whatever the SKU, for anomalies without one."""
    rows = ctx.table("purchase_orders").orderBy(F.desc_nulls_first("order_date"), F.desc("po_number"), F.desc("unit_cost")).limit(limit)
    return rows.withColumn("k", F.row_number().over(Window.orderBy(F.desc_nulls_first("order_date"), F.desc("po_number"), F.desc("unit_cost")))).agg(_orders().alias("orders"), F.count("*").alias("n"))  # ``limit`` rows


def _orders() -> Column:
    fields = ["po_number", "order_date", "expected_date", "received_date", "qty_ordered", "qty_received", "unit_cost"]
    return F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("k", F.struct(*fields).alias("o")))), lambda x: x.o))


def lead_time(ctx: Context) -> DataFrame:
    rows = ctx.table("purchase_orders").where("received_date IS NOT NULL AND order_date IS NOT NULL")
    return rows.groupBy("supplier").agg(F.avg(F.datediff("received_date", "order_date")).alias("avg_days"), F.count("*").alias("orders"))


def price_range(ctx: Context, days: int = 30) -> DataFrame:
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(days)) & (F.col("unit_price") > 0))
    return rows.groupBy("sku").agg(F.min("unit_price").alias("min_price"), F.avg("unit_price").alias("avg_price"), F.max("unit_price").alias("max_price"), F.count("*").alias("transactions"))


def margin(ctx: Context) -> DataFrame:
    """Gross margin at the average price of the last 30 days; a loss supports."""
    rows = price_range(ctx).join(ctx.table("products").select("sku", "unit_cost"), "sku")
    m = ratio(F.col("avg_price") - F.col("unit_cost"), F.col("avg_price"), 100)
    return rows.select("sku", "unit_cost", m.alias("margin_pct"), (m < 0).alias("supports"))


def last_ingestion(ctx: Context) -> DataFrame:
    """When each kind of data last came in whole, as a JSON object, in one row."""
    rows = ctx.table("runs").where("status = 'completed'").groupBy("data_type").agg(F.date_format(F.max("completed_at"), "yyyy-MM-dd HH:mm:ss").alias("at"))
    return rows.agg(_series("data_type", "at").alias("last_runs"), F.count("*").alias("data_types"))


def sku_counts(ctx: Context) -> DataFrame:
    return ctx.table("sales").agg(F.count_distinct("sku").alias("sold_skus")).crossJoin(ctx.table("products").agg(F.count("*").alias("product_rows")))


def shown_values(ctx: Context) -> DataFrame:
    """A value with two digits and its unit, else its text, else a dash."""
    number = F.concat_ws(" ", F.format_number("value_numeric", 2), F.col("unit"))
    return ctx.table("evidence").select("id", F.when(F.col("value_numeric").isNotNull(), number).otherwise(F.coalesce("value_text", F.lit("-"))).alias("shown"))


def first_values(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New evidence whose (investigation, anomaly, label) isn't there yet: what was seen first stays."""
    return new.join(existing, ["investigation_id", "anomaly_id", "label"], "left_anti")


def strongest(ctx: Context, limit: int = 4) -> DataFrame:
    """The strongest pieces of each investigation."""
    rank = F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).otherwise(1)
    w = Window.partitionBy("investigation_id").orderBy(F.desc(rank), "id")
    return ctx.table("evidence").withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("investigation_id", "k", "label", "strength")


# Kinds of rules, and the label, source, unit and strength of what is collected for each.
FAMILIES = {
    "sales": ("sales_spike", "sales_drop", "demand_seasonality_breach"),
    "places": ("cannibalization_signal", "channel_mix_shift", "store_outlier"),
    "returns": ("return_rate_spike",),
    "inventory": ("stockout_risk", "safety_stock_breach", "dead_stock", "phantom_inventory", "multi_location_imbalance", "inventory_shrinkage", "reorder_point_staleness"),
    "purchasing": ("po_overdue", "receiving_discrepancy", "supplier_lead_time_drift", "cost_spike"),
    "financial": ("price_anomaly", "margin_erosion", "discount_signal", "revenue_concentration_risk", "slow_moving_capital"),
    "data": ("import_frequency_gap", "duplicate_transaction_ids", "sku_master_drift", "location_proliferation"),
}
LABELS = {
    "series": ("Daily sales last 14 days", "sales_transactions", "units/day", "strong"),
    "units": ("Total units sold (last 14 days)", "sales_transactions", "units", "strong"),
    "mean": ("Baseline mean daily sales (90-day)", "sku_baselines", "units/day", "strong"),
    "stddev": ("Baseline stddev daily sales (90-day)", "sku_baselines", "units/day", "moderate"),
    "z": ("Z-score of most recent day vs baseline", "sku_baselines", "\u03c3", "strong"),
    "places": ("Units sold by location (last 30 days)", "sales_transactions", "units", "strong"),
    "returned": ("Return units (last 30 days)", "sales_transactions", "units", "strong"),
    "return_rate": ("Return rate (returns / gross sales, last 30 days)", "sales_transactions", "%", "strong"),
    "on_hand": ("Current on-hand quantity", "inventory_levels", "units", "strong"),
    "reorder": ("Reorder point", "inventory_levels", "units", "strong"),
    "cover": ("Days of cover at current sales rate", "inventory_levels + sales_transactions", "days", "strong"),
    "orders": ("Recent purchase orders (last 10)", "purchase_orders", None, "moderate"),
    "lead_time": ("Average supplier lead time (recent POs)", "purchase_orders", "days", "moderate"),
    "prices": ("Price range last 30 days (min / avg / max)", "sales_transactions", "$", "strong"),
    "unit_cost": ("Unit cost (product master)", "products", "$", "strong"),
    "margin": ("Gross margin at average sale price", "sales_transactions + products", "%", "strong"),
    "imports": ("Last successful import per data type", "ingestion_runs", None, "strong"),
    "sku_counts": ("Distinct SKUs in sales vs product master", "sales_transactions + products", "SKUs", "strong"),
}


def _fact(kind: str, direction: str | Column, numeric: Column | None = None, json: Column | None = None, when: Column | None = None) -> Column:
    label, source, unit, strength = LABELS[kind]
    lit = lambda x: F.lit(x).cast("string")
    value = (numeric if numeric is not None else F.lit(None)).cast("double")
    fact = F.struct(lit(label).alias("label"), lit(source).alias("source"), lit(unit).alias("unit"), (lit(direction) if isinstance(direction, str) else direction).alias("direction"), lit(strength).alias("strength"), value.alias("value_numeric"), (json if json is not None else lit(None)).alias("value_json"))
    return fact if when is None else F.when(when, fact)


def _anomalies(ctx: Context, family: str) -> DataFrame:
    return ctx.table("anomalies").where(F.col("investigation_id").isNotNull() & F.col("rule_type").isin(*FAMILIES[family])).select("investigation_id", F.col("id").alias("anomaly_id"), "rule_type", "sku", "store_id")


def _facts(rows: DataFrame, *facts: Column) -> DataFrame:
    each = F.explode(F.array_compact(F.array(*facts))).alias("f")
    return rows.select("investigation_id", "anomaly_id", each).select("investigation_id", "anomaly_id", "f.*")


def _sales_facts(ctx: Context) -> DataFrame:
    """Series, sum, the exact baseline (of the store where the anomaly has one; no fallback) and the last day's z."""
    days = ctx.table("sales").where((F.col("date") >= ctx.day(14)) & (F.col("quantity") > 0)).groupBy(F.col("sku").alias("d_sku"), F.col("store_id").alias("d_store"), "date").agg(F.sum("quantity").alias("q"))
    a = _anomalies(ctx, "sales")
    near = a.join(days, (a.sku == days.d_sku) & (a.store_id.isNull() | (a.store_id == days.d_store)), "left").groupBy("anomaly_id", "date").agg(F.sum("q").cast("double").alias("q"))
    near = near.groupBy("anomaly_id").agg(_series("date", "q").alias("series"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("units"), F.max_by("q", "date").alias("latest"))
    wide = baselines.daily_sales(ctx).select("sku", F.lit(None).cast("long").alias("store_id"), "mean", "stddev")
    exact = wide.unionByName(baselines.daily_sales(ctx, True).select("sku", "store_id", "mean", "stddev")).withColumnsRenamed({"sku": "b_sku", "store_id": "b_store"})
    rows = a.join(near, "anomaly_id", "left").join(exact, (F.col("sku") == F.col("b_sku")) & F.col("store_id").eqNullSafe(F.col("b_store")) & F.col("rule_type").isin("sales_spike", "sales_drop"), "left")
    z = baselines.z_score(F.col("latest"), F.col("mean"), F.col("stddev"))
    some = F.col("mean").isNotNull()
    return _facts(
        rows, _fact("series", "supports", json=F.when(F.col("latest").isNull(), F.lit("{}")).otherwise(F.col("series"))), _fact("units", "supports", F.col("units")), _fact("mean", "neutral", F.col("mean"), when=some), _fact("stddev", "neutral", F.col("stddev"), when=some),
        _fact("z", F.when(z > 0, "supports").otherwise("contradicts"), F.round(z, 3), when=some & F.col("latest").isNotNull()),
    )


def _place_facts(ctx: Context) -> DataFrame:
    places = by_location(ctx).withColumn("units", F.col("units").cast("double")).where("location IS NOT NULL").groupBy("sku").agg(_series("location", "units").alias("places"))
    return _facts(_anomalies(ctx, "places").join(places, "sku", "left"), _fact("places", "supports", json=F.coalesce("places", F.lit("{}"))))


def _return_facts(ctx: Context) -> DataFrame:
    rows = _anomalies(ctx, "returns").join(returns(ctx), "sku", "left")
    return _facts(rows, _fact("returned", "supports", F.coalesce("returned", F.lit(0))), _fact("return_rate", "supports", F.round("rate", 2), when=F.col("gross") > 0))


def _inventory_facts(ctx: Context) -> DataFrame:
    """The newest level of the anomaly's SKU, at its store where it has one."""
    a, level = _anomalies(ctx, "inventory"), ctx.table("inventory").select(F.col("sku").alias("l_sku"), F.col("store_id").alias("l_store"), "on_hand_qty", "reorder_point", "as_of_date", F.col("id").alias("l_id"))
    newest = F.max_by(F.struct("on_hand_qty", "reorder_point"), F.struct(F.coalesce("as_of_date", F.lit("9999-12-31").cast("date")), -F.col("l_id")))
    rows = a.join(level, (a.sku == level.l_sku) & (a.store_id.isNull() | (a.store_id == level.l_store))).groupBy("investigation_id", "anomaly_id", "sku").agg(newest.alias("l"))
    pace = ctx.table("sales").where((F.col("date") >= ctx.day(30)) & (F.col("quantity") > 0)).groupBy("sku").agg((F.sum("quantity").cast("double") / 30.0).alias("pace"))
    rows = rows.join(pace, "sku", "left").select("investigation_id", "anomaly_id", "l.*", "pace")
    cover = F.round(F.col("on_hand_qty").cast("double") / F.col("pace") + 1e-9, 1)
    return _facts(
        rows, _fact("on_hand", "supports", F.col("on_hand_qty")), _fact("reorder", "neutral", F.col("reorder_point"), when=F.col("reorder_point").isNotNull()), _fact("cover", F.when(cover < 7, "supports").otherwise("neutral"), cover, when=F.col("pace") > 0)
    )


def _order_facts(ctx: Context) -> DataFrame:
    days = F.datediff("received_date", "order_date")
    slow = ctx.table("purchase_orders").where("received_date IS NOT NULL AND order_date IS NOT NULL").groupBy("sku").agg(F.avg(days).alias("lead"))
    a = _anomalies(ctx, "purchasing")
    own = a.where("sku IS NOT NULL").join(last_orders(ctx).select("sku", "orders"), "sku").join(slow, "sku", "left")
    loose = a.where("sku IS NULL").crossJoin(F.broadcast(last_orders_of_all(ctx).where("n > 0").select("orders"))).withColumn("lead", F.lit(None).cast("double"))  # one row
    return _facts(own.unionByName(loose.select(own.columns)), _fact("orders", "supports", json=F.col("orders")), _fact("lead_time", "neutral", F.round("lead", 1), when=F.col("lead").isNotNull()))


def _financial_facts(ctx: Context) -> DataFrame:
    p = ctx.table("products").select("sku", "unit_cost")
    rows = _anomalies(ctx, "financial").join(price_range(ctx), "sku", "left").join(p, "sku", "left")
    margin_ = ratio(F.col("avg_price") - F.col("unit_cost"), F.col("avg_price"), 100)
    prices = F.to_json(F.struct(F.round("min_price", 2).alias("min"), F.round("avg_price", 2).alias("avg"), F.round("max_price", 2).alias("max")))
    return _facts(
        rows, _fact("prices", "supports", json=prices, when=F.col("transactions") > 0), _fact("unit_cost", "neutral", F.col("unit_cost"), when=F.col("unit_cost").isNotNull()), _fact("margin", F.when(margin_ < 0, "supports").otherwise("neutral"), F.round(margin_, 2), when=margin_.isNotNull())
    )


def _data_facts(ctx: Context) -> DataFrame:
    one = last_ingestion(ctx).crossJoin(sku_counts(ctx))  # rows of one
    rows = _anomalies(ctx, "data").crossJoin(F.broadcast(one))
    more = F.when(F.col("sold_skus") > F.col("product_rows"), "supports").otherwise("contradicts")
    counts = F.to_json(F.struct(F.col("sold_skus").alias("in_sales"), F.col("product_rows").alias("in_products")))
    return _facts(rows, _fact("imports", "supports", json=F.col("last_runs"), when=F.col("data_types") > 0), _fact("sku_counts", more, json=counts, when=F.col("rule_type") == "sku_master_drift"))


COLLECTORS = {"sales": _sales_facts, "places": _place_facts, "returns": _return_facts, "inventory": _inventory_facts, "purchasing": _order_facts, "financial": _financial_facts, "data": _data_facts}


def collected(ctx: Context, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """New evidence for all anomalies in investigations, by kind of rule; of an (investigation, anomaly, label) what is there stays."""
    out = None
    for family in families:
        rows = COLLECTORS[family](ctx)
        out = rows if out is None else out.unionByName(rows)
    return first_values(ctx.table("evidence").select("investigation_id", "anomaly_id", "label"), out)
