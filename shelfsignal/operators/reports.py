"""Dashboard widgets, list views and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import hours_between, priority_rank, rule_label, severity_rank, sla_level, words
from ..schema import SEVERITIES
from .metrics import pct


def spine(ctx: Context, first: Column, last: Column) -> DataFrame:
    """One row for each day from first to last."""
    one = next(iter(ctx.tables.values()))
    spark = (one if isinstance(one, DataFrame) else one()).sparkSession
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))


def sales_trend(ctx: Context, days: int = 30) -> DataFrame:
    """Revenue and units of each of the last days + 1 days, zero where nothing was sold."""
    rows = ctx.table("sales").where(F.col("date") >= ctx.day(days)).groupBy(F.col("date").alias("day")).agg(F.sum("total_amount").alias("revenue"), F.sum(F.when(F.col("quantity") > 0, F.col("quantity"))).alias("units"))
    return spine(ctx, ctx.day(days), ctx.day()).join(rows, "day", "left").select("day", F.coalesce("revenue", F.lit(0)).alias("revenue"), F.coalesce("units", F.lit(0)).alias("units"))


def top_skus(ctx: Context, days: int = 30, limit: int = 10) -> DataFrame:
    rows = ctx.table("sales").where((F.col("date") >= ctx.day(days)) & (F.col("quantity") > 0)).groupBy("sku").agg(F.sum("total_amount").alias("revenue"))
    return rows.orderBy(F.desc("revenue"), "sku").limit(limit)


def inventory_health(ctx: Context, limit: int = 10) -> DataFrame:
    """Stockouts, levels at risk and healthy ones by location; by store only where no location is known at all."""
    out = F.col("on_hand_qty") <= 0
    risk = ~out & F.col("reorder_point").isNotNull() & (F.col("on_hand_qty") <= F.col("reorder_point"))
    by = F.when(F.col("location").isNotNull(), F.struct(F.lit(1).alias("kind"), F.col("location").alias("place"))).when(F.col("store_id").isNotNull(), F.struct(F.lit(0).alias("kind"), F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("place")))
    rows = ctx.table("inventory").groupBy(by.alias("by")).agg(F.count_if(out).alias("stockout"), F.count_if(risk).alias("at_risk"), F.count_if(~out & ~risk).alias("healthy"), F.count("*").alias("n")).where("by IS NOT NULL")
    kind = ctx.table("inventory").agg(F.max((F.col("location").isNotNull()).cast("int")).alias("kind"))
    rows = rows.select("by.*", "stockout", "at_risk", "healthy", "n").join(F.broadcast(kind), "kind")  # one row
    return rows.orderBy(F.desc("n"), "place").limit(limit).drop("n", "kind")


def po_fulfilment(ctx: Context) -> DataFrame:
    """Open, late and received orders, and the share of all orders that has been received; 0 without orders."""
    open_, got = F.col("received_date").isNull(), F.count("received_date")
    rate = F.when(F.count("*") > 0, F.round(got.cast("double") / F.count("*") * 100, 0)).otherwise(0.0)
    return ctx.table("purchase_orders").agg(
        F.count_if(open_).alias("open"), F.count_if(open_ & (F.col("expected_date") < ctx.day())).alias("overdue"), F.count_if(F.col("received_date") >= F.trunc(ctx.day(), "month")).alias("received_this_month"), rate.alias("fulfilment_pct")
    )


def anomaly_trend(ctx: Context, days: int = 30) -> DataFrame:
    """Anomalies of each severity on each of ``days`` days, zero where there are none."""
    day = F.col("detected_at").cast("date").alias("day")
    last = F.lit(ctx.now).cast("date")
    rows = ctx.table("anomalies").groupBy(day).pivot("severity", list(SEVERITIES)).count()
    return spine(ctx, F.date_sub(last, days - 1), last).join(rows, "day", "left").select("day", *(F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES))


def anomalies_by_store(ctx: Context, days: int = 30) -> DataFrame:
    """Anomalies of the last ``days`` by the number of their store, with its name; a store without a row counts, too."""
    rows = ctx.table("anomalies").where((F.col("detected_at").cast("timestamp_ntz") >= ctx.clock(24 * days)) & F.col("store_id").isNotNull()).groupBy("store_id").agg(F.count("*").alias("anomalies"))
    stores = ctx.table("stores").select(F.col("id").alias("store_id"), F.col("name").alias("store"))
    return rows.join(stores, "store_id", "left").select(F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("name"), "store", "anomalies")


def overview(ctx: Context) -> DataFrame:
    """Row counts, levels at their reorder point, imports under way, open anomalies and what is said of them, in one row.

    Each table is aggregated to one row before they are joined.
    """
    count = lambda table, **of: ctx.table(table).agg(*(F.count_if(F.expr(where)).alias(name) for name, where in of.items()))
    row = count("products", products="true").crossJoin(count("sales", sales="true"))
    row = row.crossJoin(count("inventory", inventory="true", low_stock="on_hand_qty <= reorder_point")).crossJoin(count("stores", stores="true")).crossJoin(count("purchase_orders", purchase_orders="true"))
    row = row.crossJoin(count("imports", pending_imports="status IN ('uploaded', 'mapping_review', 'importing')"))
    live = "dismissed_at IS NULL"
    row = row.crossJoin(count("anomalies", open_anomalies=live, high_anomalies=f"{live} AND severity = 'high'", medium_anomalies=f"{live} AND severity = 'medium'"))
    high, medium, any_ = F.col("high_anomalies"), F.col("medium_anomalies"), F.col("open_anomalies")
    said = lambda n, kind: F.concat(n.cast("string"), F.lit(f" {kind} severity"))
    return row.withColumns(
        {
            "banner": F.when(high > 0, said(high, "high")).when(medium > 0, said(medium, "medium")).when(any_ > 0, said(any_, "low")).otherwise("No open anomalies"),
            "colour": F.when(high > 0, "danger").when(medium > 0, "warning").when(any_ > 0, "info").otherwise("success"),
        }
    )


def investigation_overview(ctx: Context, days: int = 7) -> DataFrame:
    """Open, running, critical and high ones, those resolved in the last ``days``, and how long open ones have been open."""
    open_, at = F.col("status").isin("open", "in_progress"), F.col("resolved_at").cast("timestamp_ntz")
    hours = hours_between(ctx.clock(), F.col("opened_at"))
    return ctx.table("investigations").agg(
        F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "in_progress").alias("in_progress"), F.count_if(open_ & (F.col("priority") == "critical")).alias("critical"), F.count_if(open_ & (F.col("priority") == "high")).alias("high"),
        F.count_if((F.col("status") == "resolved") & (at >= ctx.clock(24 * days))).alias("recently_resolved"), F.round(F.avg(F.when(open_, hours)), 1).alias("avg_open_hours"),
    )


def kpi_trends(ctx: Context, days: int = 7, waiting: tuple[str, ...] = ("pending",), late_hours: float = 48) -> DataFrame:
    """The dashboard's five figures, each with the one that it is held against, the change in percent and its direction.

    Money at risk, open and urgent investigations are held against those opened
    in the window before the last one, recovery of this month against the last
    month's; late actions (in one of ``waiting``, which nothing writes any
    more) stand alone. Without an earlier figure there is no change.
    """
    opened, open_, urgent = F.col("opened_at").cast("timestamp_ntz"), F.col("status").isin("open", "in_progress"), F.col("priority").isin("high", "critical")
    before = (opened >= ctx.clock(48 * days)) & (opened < ctx.clock(24 * days))
    number_ = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    risk = lambda where: number_(F.sum(F.when(where, F.col("revenue_at_risk"))))
    i = ctx.table("investigations")
    row = i.agg(risk(open_).alias("a"), risk(before).alias("b"), number_(F.count_if(open_)).alias("c"), number_(F.count_if(before)).alias("d"), number_(F.count_if(open_ & urgent)).alias("e"), number_(F.count_if(before & urgent)).alias("f"))
    late = ctx.table("actions").where(F.col("status").isin(*waiting) & (F.col("created_at").cast("timestamp_ntz") < ctx.clock(late_hours)))
    late = late.join(i.where(open_).select(F.col("id").alias("investigation_id")), "investigation_id", "left_semi").agg(number_(F.count("*")).alias("g"))
    month, day = F.trunc(F.lit(ctx.now).cast("date"), "month"), F.col("recorded_at").cast("date")
    back = lambda where: number_(F.sum(F.when(where, F.col("revenue_recovered"))))
    money_ = ctx.table("outcomes").agg(back(day >= month).alias("h"), back((day >= F.add_months(month, -1)) & (day < month)).alias("i"))
    rows = row.crossJoin(late).crossJoin(money_).selectExpr("stack(5, 'revenue_at_risk', a, b, 'open_investigations', c, d, 'high_priority', e, f, 'overdue_actions', g, cast(null as double), 'recovered_mtd', h, i) AS (kpi, value, previous)")  # rows of one
    change = F.when(F.col("previous") != 0, F.round((F.col("value") - F.col("previous")) / F.abs("previous") * 100 + F.signum(F.col("value") - F.col("previous")) * 1e-9, 1))
    return rows.withColumns({"change_pct": F.abs(change), "direction": F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")})


def top_drivers(ctx: Context, limit: int = 5) -> DataFrame:
    """The rules with most open anomalies, and their share of what these rules have together."""
    rows = ctx.table("anomalies").where("dismissed_at IS NULL").groupBy("rule_type").agg(F.count("*").alias("anomalies")).orderBy(F.desc("anomalies"), "rule_type").limit(limit)
    return rows.withColumn("share", pct(F.col("anomalies"), F.sum("anomalies").over(Window.partitionBy())))  # ``limit`` rows


def insights(ctx: Context) -> DataFrame:
    """The rule that recurs most and the one seen most this month among open anomalies, a row each."""
    live, day = ctx.table("anomalies").where("dismissed_at IS NULL"), F.col("detected_at").cast("date")
    month = F.trunc(F.lit(ctx.now).cast("date"), "month")
    first = lambda rows, name: rows.groupBy("rule_type").agg(F.count("*").alias("anomalies")).orderBy(F.desc("anomalies"), "rule_type").limit(1).select(F.lit(name).alias("insight"), "rule_type", "anomalies")
    return first(live.where("ai_is_recurring"), "recurring").unionByName(first(live.where(day >= month), "this_month"))


def pending_actions(ctx: Context, statuses: tuple[str, ...] = ("pending",), limit: int = 6) -> DataFrame:
    """The oldest actions of open investigations in one of ``statuses``; nothing writes the default one any more."""
    i = ctx.table("investigations").where(F.col("status").isin("open", "in_progress")).select(F.col("id").alias("investigation_id"))
    rows = ctx.table("actions").where(F.col("status").isin(*statuses)).join(i, "investigation_id", "left_semi")
    return rows.orderBy("created_at", "id").limit(limit).select("id", "investigation_id", "title", "status")


def _active() -> Column:
    return ~F.col("status").isin("completed", "cancelled")


def _due_tabs(ctx: Context) -> dict[str, Column]:
    """Which actions are under each tab; a week ends on its Sunday."""
    due, day, today = F.col("due_at").cast("timestamp_ntz"), F.col("due_at").cast("date"), F.lit(ctx.now).cast("date")
    return {
        "all": F.lit(True), "overdue": _active() & (due < ctx.clock()), "due_today": _active() & (day == today), "due_week": _active() & day.between(today, F.next_day(F.date_sub(today, 1), "SUN")),
        "in_progress": F.col("status") == "in_progress", "completed": F.col("status") == "completed",
    }


def sla_compliance(ctx: Context) -> DataFrame:
    """Active actions with a deadline: overdue, at risk within a day, on track."""
    left = hours_between(F.col("due_at"), ctx.clock())
    state = F.when(left < 0, "overdue").when(left < 24, "at_risk").otherwise("on_track")
    return ctx.table("actions").where(_active() & F.col("due_at").isNotNull()).groupBy(state.alias("sla")).agg(F.count("*").alias("actions"))


def action_counts(ctx: Context) -> DataFrame:
    """Counts of the tabs of an action list (all: the active ones), and of those completed this month."""
    month = F.trunc(F.col("completed_at").cast("date"), "month") == F.trunc(F.lit(ctx.now).cast("date"), "month")
    tabs = _due_tabs(ctx) | {"all": _active(), "completed_this_month": (F.col("status") == "completed") & month}
    return ctx.table("actions").agg(*(F.count_if(where).alias(tab) for tab, where in tabs.items()))


def actions_by_type(ctx: Context, limit: int = 8) -> DataFrame:
    """The kinds of active actions that are most frequent."""
    return ctx.table("actions").where(_active()).groupBy("action_type").agg(F.count("*").alias("actions")).orderBy(F.desc("actions"), "action_type").limit(limit)


def upcoming_deadlines(ctx: Context, days: int = 3, limit: int = 8) -> DataFrame:
    """The active actions that are due soonest, or were, within ``days``."""
    due = F.col("due_at").cast("timestamp_ntz")
    return ctx.table("actions").where(_active() & (due <= ctx.clock(-24 * days))).orderBy("due_at", "id").limit(limit).select("id", "action_type", "priority")


def action_page(ctx: Context, search: str, page: int = 1, size: int = 25) -> DataFrame:
    """A page of active actions whose title, description or investigation's title has ``search``, by priority and due time."""
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), F.col("title").alias("i_title"))
    rows = ctx.table("actions").join(i, "investigation_id").where(_active() & reduce(Column.__or__, (F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False)) for c in ("title", "description", "i_title"))))
    rows = rows.orderBy(F.desc(priority_rank(F.col("priority"))), F.asc_nulls_last("due_at"), F.asc("id")).offset((page - 1) * size).limit(size)
    return rows.select("id", "title", "status", "priority")


def investigation_page(ctx: Context, status: str | None = "open", priority: str | None = None, rule: str | None = None, search: str = "", store: int | None = None, sort: str = "revenue_at_risk", descending: bool = True, page: int = 1, size: int = 25) -> DataFrame:
    """A page of investigations; ``open`` takes in_progress too, ``high_critical`` both; by priority the most urgent come first."""
    like = lambda c: F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
    rows = ctx.table("investigations").where(like("title") | like("primary_sku") | like("description"))
    if status:
        rows = rows.where(F.col("status").isin("open", "in_progress") if status == "open" else F.col("status") == status)
    if priority:
        rows = rows.where(F.col("priority").isin("high", "critical") if priority == "high_critical" else F.col("priority") == priority)
    if store is not None:
        rows = rows.where(F.col("primary_store_id") == store)
    if rule:
        rows = rows.join(ctx.table("anomalies").where(F.col("rule_type") == rule).select(F.col("investigation_id").alias("id")), "id", "left_semi")
    by = F.desc(priority_rank(F.col("priority"))) if sort == "priority" else F.desc_nulls_first(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(by, "id").offset((page - 1) * size).limit(size).select("id", "title", "status", "priority", "revenue_at_risk")


def anomaly_list(ctx: Context, limit: int = 50) -> DataFrame:
    """Open anomalies by severity, then newest."""
    return ctx.table("anomalies").where("dismissed_at IS NULL").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("detected_at"), "id").limit(limit).select("id", "rule_type", "severity", "sku")


def digest(ctx: Context, severities: tuple[str, ...] = ("high",)) -> DataFrame:
    """Anomalies to notify: open, not yet notified, of the wanted severities."""
    return ctx.table("anomalies").where(F.col("dismissed_at").isNull() & F.col("notified_at").isNull() & F.col("severity").isin(*severities)).select("id", "rule_type", "severity", "sku")


def digests(tenants: DataFrame, anomalies: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What each tenant with an address is told: its open anomalies of the severities that it wants and was not told of, the worst and newest first; and all anomalies with those marked as told.

    ``tenants``: id, notification_email, notify_on_high, notify_on_medium.
    """
    wants = F.array_compact(F.array(F.when(F.col("notify_on_high"), "high"), F.when(F.col("notify_on_medium"), "medium")))
    t = tenants.where("notification_email IS NOT NULL").select(F.col("id").alias("tenant_id"), "notification_email", wants.alias("_wants"))
    rows = anomalies.where("dismissed_at IS NULL AND notified_at IS NULL").join(t, "tenant_id").where(F.array_contains("_wants", F.col("severity")))
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("detected_at"), "id"))
    told = rows.select("tenant_id", "notification_email", "id", "rule_type", "severity", "sku", place.alias("place"))
    marked = anomalies.join(rows.select("id", F.lit(True).alias("_told")), "id", "left")
    return told, marked.withColumn("notified_at", F.when(F.col("_told"), now).otherwise(F.col("notified_at").cast("timestamp_ntz"))).drop("_told")


def count_by(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias(field)).agg(F.count("*").alias("n"))


def report_by_rule(ctx: Context) -> DataFrame:
    return ctx.table("anomalies").groupBy("rule_type").agg(F.count("*").alias("detections"), F.count_if(F.col("dismissed_at").isNotNull()).alias("dismissed"), F.count_if("is_false_positive").alias("false_positives"), F.sum("revenue_impact").alias("impact"))


def financial_breakdown(ctx: Context, limit: int = 200) -> DataFrame:
    """Open investigations with the largest revenue at risk, and their share of the total."""
    rows = ctx.table("investigations").where(F.col("status").isin("open", "in_progress") & (F.col("revenue_at_risk") > 0))
    total = rows.agg(F.sum("revenue_at_risk").alias("total"))
    return rows.crossJoin(total).withColumn("share", pct(F.col("revenue_at_risk"), F.col("total"))).orderBy(F.desc("revenue_at_risk"), "id").limit(limit).select("id", "status", "revenue_at_risk", "share")


def store_counts(ctx: Context) -> DataFrame:
    """Stores with their sales rows and inventory levels."""
    s = ctx.table("sales").groupBy("store_id").agg(F.count("*").alias("sales"))
    i = ctx.table("inventory").groupBy("store_id").agg(F.count("*").alias("levels"))
    rows = ctx.table("stores").select(F.col("id").alias("store_id"), "name").join(s, "store_id", "left").join(i, "store_id", "left")
    return rows.select("name", F.coalesce("sales", F.lit(0)).alias("sales"), F.coalesce("levels", F.lit(0)).alias("levels"))


def supplier_counts(ctx: Context) -> DataFrame:
    """Suppliers with their purchase orders, matched by name."""
    p = ctx.table("purchase_orders").groupBy(F.col("supplier").alias("name")).agg(F.count("*").alias("orders"), F.sum("qty_ordered").alias("units"))
    return ctx.table("suppliers").select("name").join(p, "name", "left").select("name", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("units", F.lit(0)).alias("units"))


def sales_list(ctx: Context, location: str, first, last) -> DataFrame:
    return ctx.table("sales").where((F.col("location") == location) & F.col("date").between(F.lit(first), F.lit(last))).select("date", "sku", "quantity", "total_amount")


def filtered(rows: DataFrame, date: str | None = None, first=None, last=None, **equal) -> DataFrame:
    """Rows of a list view: inclusive bounds of a date, and columns that must have a value where one is given."""
    if date and first is not None:
        rows = rows.where(F.col(date) >= F.lit(first))
    if date and last is not None:
        rows = rows.where(F.col(date) <= F.lit(last))
    for column, value in equal.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def choices(rows: DataFrame, column: str) -> DataFrame:
    """What a list can be filtered by."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct()


def order_list(ctx: Context, supplier: str | None = None, first=None, last=None) -> DataFrame:
    return filtered(ctx.table("purchase_orders"), "order_date", first, last, supplier=supplier).select("po_number", "supplier", "sku", "order_date", "qty_ordered", "qty_received")


def return_list(ctx: Context, location: str | None = None, first=None, last=None) -> DataFrame:
    return filtered(ctx.table("returns"), "date", first, last, location=location).select("date", "sku", "location", "quantity", "value")


def inventory_list(ctx: Context, location: str | None = None, low: bool = False) -> DataFrame:
    rows = filtered(ctx.table("inventory"), location=location)
    return (rows.where("reorder_point > 0 AND on_hand_qty <= reorder_point") if low else rows).select("sku", "location", "on_hand_qty", "reorder_point", "as_of_date")


def product_list(ctx: Context, category: str | None = None) -> DataFrame:
    return filtered(ctx.table("products"), category=category).select("sku", "name", "category", "unit_cost", "selling_price")


# What only administrators may do.
GATED = ("manage_users", "manage_imports", "dismiss_anomalies", "change_thresholds", "reassign", "close", "change_status", "record_outcomes", "view_audit")


def access(ctx: Context, tenant_id: int) -> DataFrame:
    """Whether each user sees the tenant, their role there, and whether what is gated is open to them; exports are to all."""
    admin, chief = F.coalesce("is_admin", F.lit(False)), F.coalesce("is_super_admin", F.lit(False))
    role = F.when(chief, "Super Admin").when(admin, "Tenant Admin").otherwise("User")
    return ctx.table("users").select("id", (chief | (F.col("tenant_id") == tenant_id)).alias("sees"), role.alias("role"), (chief | admin).alias("gated"), F.lit(True).alias("exports"))


def record_key(keys: DataFrame) -> DataFrame:
    """The id in a JSON key, in it or in its data; other keys pass."""
    return keys.withColumn("record_id", F.coalesce(F.get_json_object("key", "$.id"), F.get_json_object("key", "$.data.id"), F.col("key")))


def badges(ctx: Context, user_id: int) -> DataFrame:
    i = ctx.table("investigations").agg(F.count_if(F.col("status").isin("open", "in_progress") & F.col("priority").isin("high", "critical")).alias("urgent"))
    s = ctx.table("suppressions").agg(F.count_if("active").alias("suppressions"))
    w = ctx.table("watches").agg(F.count_if(F.col("user_id") == user_id).alias("watches"))
    return i.crossJoin(s).crossJoin(w)  # rows of one


def status_breakdown(ctx: Context) -> DataFrame:
    rows = ctx.table("investigations").groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("revenue_at_risk"), F.lit(0)).alias("at_risk"))
    return rows.withColumn("share", pct(F.col("n"), F.sum("n").over(Window.partitionBy())))  # one row a status


def money_series(ctx: Context, days: int = 30) -> DataFrame:
    """Revenue at risk of investigations by day opened and recovery by day recorded, zero on other days."""
    last = F.lit(ctx.now).cast("date")
    risk = ctx.table("investigations").groupBy(F.col("opened_at").cast("date").alias("day")).agg(F.sum("revenue_at_risk").alias("at_risk"))
    back = ctx.table("outcomes").groupBy(F.col("recorded_at").cast("date").alias("day")).agg(F.sum("revenue_recovered").alias("recovered"))
    rows = spine(ctx, F.date_sub(last, days - 1), last).join(risk, "day", "left").join(back, "day", "left")
    return rows.select("day", F.coalesce("at_risk", F.lit(0)).alias("at_risk"), F.coalesce("recovered", F.lit(0)).alias("recovered"))


def top_alert_store(ctx: Context, days: int = 14) -> DataFrame:
    rows = ctx.table("anomalies").where(F.col("dismissed_at").isNull() & (F.col("detected_at").cast("timestamp_ntz") >= ctx.clock(24 * days)) & F.col("store_id").isNotNull()).groupBy("store_id").agg(F.count("*").alias("anomalies"))
    return rows.orderBy(F.desc("anomalies"), "store_id").limit(1)


def recent_urgent(ctx: Context, limit: int = 6) -> DataFrame:
    rows = ctx.table("investigations").where(F.col("status").isin("open", "in_progress") & F.col("priority").isin("high", "critical"))
    return rows.orderBy(F.desc("opened_at"), "id").limit(limit).select("id", "priority", "status")


def dossier(ctx: Context) -> DataFrame:
    """Each anomaly with its investigation, the number of pieces of evidence and the outcome."""
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "title", "status")
    e = ctx.table("evidence").groupBy("investigation_id").agg(F.count("*").alias("pieces"))
    o = ctx.table("outcomes").select("investigation_id", "outcome_type")
    rows = ctx.table("anomalies").join(i, "investigation_id", "left").join(e, "investigation_id", "left").join(o, "investigation_id", "left")
    return rows.select("id", "rule_type", "title", "status", F.coalesce("pieces", F.lit(0)).alias("pieces"), "outcome_type")


def related_anomalies(ctx: Context, limit: int = 5) -> DataFrame:
    """The newest other anomalies of an open high anomaly's SKU; each SKU's newest ``limit`` + 1 are ranked once."""
    w = Window.partitionBy("sku").orderBy(F.desc("detected_at"), "id")
    newest = ctx.table("anomalies").where("sku IS NOT NULL").withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit + 1).select("sku", F.col("id").alias("related_id"), "k")
    a = ctx.table("anomalies").where("dismissed_at IS NULL AND severity = 'high'").select("id", "sku").join(newest, "sku").where("related_id <> id")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("k"))).where(F.col("r") <= limit).select("id", "related_id", "r")


def recovered_this_month(ctx: Context, limit: int = 200) -> DataFrame:
    first = F.trunc(F.lit(ctx.now).cast("date"), "month")
    rows = ctx.table("outcomes").where((F.col("recorded_at").cast("date") >= first) & (F.col("revenue_recovered") > 0))
    return rows.orderBy(F.desc("revenue_recovered"), "investigation_id").limit(limit).select("investigation_id", "outcome_type", "revenue_recovered")


# Periods


def available_range(ctx: Context) -> DataFrame:
    """The first day with data and the day of the clock; without data the last 30 days."""
    firsts = [ctx.table(t).agg(F.min(c).cast("date").alias("first")) for t, c in (("anomalies", "detected_at"), ("investigations", "opened_at"), ("outcomes", "recorded_at"), ("sales", "date"))]
    today = F.lit(ctx.now).cast("date")
    row = firsts[0].unionByName(firsts[1]).unionByName(firsts[2]).unionByName(firsts[3]).agg(F.min("first").alias("first"))
    return row.select(F.coalesce("first", F.date_sub(today, 30)).alias("first"), today.alias("last"))


def clamped_range(ctx: Context, requests: DataFrame) -> DataFrame:
    """``requests`` (first, last; null for open) within the available range; the whole range where nothing is left of one."""
    r = available_range(ctx).select(F.col("first").alias("a"), F.col("last").alias("z"))
    rows = requests.crossJoin(F.broadcast(r))  # one row
    first, last = F.greatest(F.coalesce("first", "a"), "a"), F.least(F.coalesce("last", "z"), "z")
    return rows.select(F.when(first > last, F.col("a")).otherwise(first).alias("first"), F.when(first > last, F.col("z")).otherwise(last).alias("last"))


def presets(ctx: Context) -> DataFrame:
    """The periods on offer: last 7, 30 and 90 days, month and year to date, all; none begins before the data."""
    day = F.col("last")
    starts = {"7d": F.date_sub(day, 7), "30d": F.date_sub(day, 30), "90d": F.date_sub(day, 90), "mtd": F.trunc(day, "month"), "ytd": F.trunc(day, "year"), "all": F.col("first")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("preset"), F.greatest(v, F.col("first")).alias("from")) for k, v in starts.items()))).alias("p")
    return available_range(ctx).select(each, F.col("last").alias("to")).select("p.*", "to")


def _within(c: str, first, last) -> Column:
    return F.col(c).cast("date").between(F.lit(first), F.lit(last))


def period_times(ctx: Context, first, last) -> DataFrame:
    """Average hours to the first action taken and to resolutions made in a period; negative ones don't count."""
    i = ctx.table("investigations")
    acted = ctx.table("actions").where(_within("created_at", first, last)).groupBy(F.col("investigation_id").alias("id")).agg(F.min("created_at").alias("acted"))
    h = hours_between(F.col("acted"), F.col("opened_at"))
    a = i.join(acted, "id").agg(F.round(F.avg(F.when(h >= 0, h)), 1).alias("hours_to_action"))
    h = hours_between(F.col("resolved_at"), F.col("opened_at"))
    return a.crossJoin(i.where(_within("resolved_at", first, last)).agg(F.round(F.avg(F.when(h >= 0, h)), 1).alias("hours_to_resolution")))


def recovery_report(ctx: Context, first, last) -> DataFrame:
    """Figures of the outcomes recorded in a period, in one row."""
    o = ctx.table("outcomes").where(_within("recorded_at", first, last))
    money_ = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = o.agg(money_("revenue_at_risk").alias("at_risk"), money_("revenue_recovered").alias("recovered"), money_("action_cost").alias("cost"), F.count_if("was_false_positive").alias("false_positives"))
    done = ctx.table("investigations").where(F.col("status").isin("resolved", "closed") & _within("resolved_at", first, last)).agg(F.count("*").alias("resolved"))
    return row.crossJoin(done).select("at_risk", "recovered", pct(F.col("recovered"), F.col("at_risk")).alias("recovery_rate"), (F.col("recovered") - F.col("cost")).alias("net_impact"), "resolved", "false_positives")


def investigation_report(ctx: Context, first, last) -> DataFrame:
    """Figures of the investigations opened in a period, in one row."""
    h = hours_between(F.col("resolved_at"), F.col("opened_at"))
    over = F.col("status").isin("resolved", "closed")
    row = ctx.table("investigations").where(_within("opened_at", first, last)).agg(
        F.count("*").alias("opened"), F.count_if(F.col("status").isin("open", "in_progress")).alias("open"), F.count_if(over).alias("resolved"), F.round(F.avg(F.when(h >= 0, h)), 1).alias("hours_to_resolution"), F.coalesce(F.sum("revenue_at_risk"), F.lit(0)).alias("at_risk")
    )
    return row.withColumn("resolution_rate", pct(F.col("resolved"), F.col("opened")))


def anomaly_report(ctx: Context, first, last) -> DataFrame:
    """Figures of the anomalies detected in a period, in one row."""
    row = ctx.table("anomalies").where(_within("detected_at", first, last)).agg(
        F.count("*").alias("detected"), F.count_if(F.col("severity") == "high").alias("high"), F.count("investigation_id").alias("correlated"), F.count("dismissed_at").alias("dismissed"), F.count_if("is_false_positive").alias("false_positives")
    )
    return row.withColumn("false_positive_rate", pct(F.col("false_positives"), F.col("detected")))


def health_report(ctx: Context, first, last) -> DataFrame:
    """The state of the data now, and what was detected and opened in a period, in one row."""
    from .health import overall

    a = ctx.table("anomalies").where(_within("detected_at", first, last)).agg(F.count("*").alias("anomalies"))
    i = ctx.table("investigations").where(_within("opened_at", first, last)).agg(F.count("*").alias("investigations"), F.count_if(F.col("status").isin("resolved", "closed")).alias("resolved"))
    row = overall(ctx).select("score", "datasets", "n_warnings").crossJoin(a).crossJoin(i)
    return row.select("score", "datasets", "n_warnings", "anomalies", "investigations", pct(F.col("resolved"), F.col("investigations")).alias("resolution_rate"))


# Where the money figures come from


def breakdown_headlines(ctx: Context) -> DataFrame:
    """The figure behind each money card, and the number of rows it comes from."""
    i = ctx.table("investigations").where(F.col("status").isin("open", "in_progress"))
    o = ctx.table("outcomes")
    month = (F.col("recorded_at").cast("date") >= F.trunc(F.lit(ctx.now).cast("date"), "month")) & (F.col("revenue_recovered") > 0)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    risk = i.agg(zero(F.sum("revenue_at_risk")).alias("revenue_at_risk"), F.count("*").alias("n_revenue_at_risk"))
    rest = o.agg(
        zero(F.sum(F.when(month, F.col("revenue_recovered")))).alias("recovered_mtd"), F.count_if(month).alias("n_recovered_mtd"), zero(F.sum("revenue_at_risk")).alias("outcome_at_risk"), F.count("revenue_at_risk").alias("n_outcome_at_risk"),
        zero(F.sum("revenue_recovered")).alias("observed_recovery"), F.count_if(F.col("revenue_recovered") > 0).alias("n_observed_recovery"), F.count_if("was_false_positive").alias("n_false_positives"),
    )
    row = risk.crossJoin(rest)  # rows of one
    rate = pct(F.col("observed_recovery"), F.col("outcome_at_risk"))
    return row.selectExpr("*").withColumn("rate", rate).selectExpr(
        "stack(6, 'revenue_at_risk', revenue_at_risk, n_revenue_at_risk, 'recovered_mtd', recovered_mtd, n_recovered_mtd, 'outcome_at_risk', outcome_at_risk, n_outcome_at_risk, 'observed_recovery', observed_recovery, n_observed_recovery,"
        " 'recovery_rate', rate, n_outcome_at_risk, 'false_positives', cast(n_false_positives as double), n_false_positives) AS (metric, value, n)"
    )


def outcome_breakdown(ctx: Context, metric: str, limit: int = 200) -> DataFrame:
    """The outcomes behind a card, the largest amounts first (for false positives the latest)."""
    o = ctx.table("outcomes")
    by = {"outcome_at_risk": ("revenue_at_risk IS NOT NULL", "revenue_at_risk"), "observed_recovery": ("revenue_recovered > 0", "revenue_recovered"), "recovery_rate": ("revenue_at_risk IS NOT NULL", "revenue_recovered"), "false_positives": ("was_false_positive", "recorded_at")}
    where, order = by[metric]
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), "title", F.col("primary_sku").alias("sku"))
    rows = o.where(where).orderBy(F.desc_nulls_first(order), "investigation_id").limit(limit)
    return rows.join(i, "investigation_id", "left").select("investigation_id", F.coalesce("title", F.concat(F.lit("Investigation #"), F.col("investigation_id").cast("string"))).alias("title"), "sku", "outcome_type", "revenue_at_risk", "revenue_recovered")


# Lists


def action_rows(ctx: Context, tab: str = "all", search: str = "", kind: str | None = None, assignee: int | None = None, priority: str | None = None, sort: str = "due_at", descending: bool = False, page: int = 1, size: int = 25) -> DataFrame:
    """A page of actions under a tab, with filters and a sort column, and the state of their deadline.

    ``search`` looks into title, description and the investigation's title. By
    priority the most urgent come first, whatever the direction; other columns
    have nulls last, or first where descending.
    """
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), F.col("title").alias("i_title"))
    like = lambda c: F.coalesce(F.col(c).ilike(f"%{search}%"), F.lit(False))
    rows = ctx.table("actions").join(i, "investigation_id").where(_due_tabs(ctx)[tab])
    rows = rows.where(like("title") | like("description") | like("i_title")) if search else rows
    for column, value in (("action_type", kind), ("assignee_id", assignee), ("priority", priority)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    by = F.desc(F.coalesce(priority_rank(F.col("priority")), F.lit(1))) if sort == "priority" else F.desc_nulls_first(sort) if descending else F.asc_nulls_last(sort)
    sla = sla_level(F.col("status"), F.col("due_at"), ctx.clock())
    return rows.orderBy(by, "id").offset((page - 1) * size).limit(size).select("id", "title", "action_type", "status", "priority", sla.alias("sla"))


def anomaly_page(ctx: Context, severity: str | None = None, rule: str | None = None, sku: str = "", dismissed: bool | None = False, page: int = 1, size: int = 25) -> DataFrame:
    """A page of anomalies, severities in the order of the alphabet, then the newest."""
    rows = ctx.table("anomalies")
    if dismissed is not None:
        rows = rows.where(F.col("dismissed_at").isNotNull() if dismissed else F.col("dismissed_at").isNull())
    for column, value in (("severity", severity), ("rule_type", rule)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.where(F.col("sku").ilike(f"%{sku}%")) if sku else rows
    return rows.orderBy("severity", F.desc("detected_at"), "id").offset((page - 1) * size).limit(size).select("id", "rule_type", "severity", "sku")


def audit_list(ctx: Context, event: str | None = None, actor: int | None = None, period: str | None = None) -> DataFrame:
    """Audit entries, the newest first, by event, actor and period (today, 7d, 30d), with actor and channel named."""
    at = F.col("created_at").cast("timestamp_ntz")
    since = {"today": F.lit(ctx.now).cast("date").cast("timestamp_ntz"), "7d": ctx.clock(24 * 7), "30d": ctx.clock(24 * 30)}.get(period)
    rows = ctx.table("audit")
    rows = rows if since is None else rows.where(at >= since)
    rows = rows if event is None else rows.where(F.col("event_type") == event)
    rows = rows if actor is None else rows.where(F.col("user_id") == actor)
    u = ctx.table("users").select(F.col("id").alias("user_id"), "name")
    channel = F.when(F.get_json_object("new_value", "$.source") == "email", "Email").otherwise("-")
    return rows.join(u, "user_id", "left").orderBy(F.desc("created_at"), "id").select("id", "event_type", F.coalesce("name", F.lit("System")).alias("actor"), channel.alias("channel"), "investigation_id")


def audit_appended(audit: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The audit log with ``entries`` (without id and time) at its end; ids go on from the last in each partition's stretch."""
    last = audit.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = entries.withColumn("part", F.monotonically_increasing_id()).crossJoin(F.broadcast(last))  # one row
    return audit.unionByName(new.withColumns({"id": F.col("last") + 1 + F.col("part"), "created_at": now}).drop("part", "last"), allowMissingColumns=True)


def investigation_detail(ctx: Context, factors: int = 5) -> DataFrame:
    """What the page of an investigation says: supporting evidence, contributing factors, impact, cause, last completed action."""
    from .evidence import shown_values

    shown = ctx.table("evidence").join(shown_values(ctx), "id")
    supports = F.transform(F.sort_array(F.collect_list(F.when(F.col("direction") == "supports", F.struct("id", F.concat("label", F.lit(": "), "shown").alias("t"))))), lambda x: x.t)
    neutral = F.sort_array(F.collect_list(F.when(F.col("direction") == "context", F.struct("id", F.col("label").alias("t")))))
    e = shown.groupBy("investigation_id").agg(F.array_join(supports, ", ").alias("evidence"), F.transform(neutral, lambda x: x.t).alias("labels"))
    said = F.sort_array(F.collect_list(F.when(F.col("description") != "", F.struct("id", F.col("description").alias("t")))))
    a = ctx.table("anomalies").where("investigation_id IS NOT NULL").groupBy("investigation_id").agg(F.transform(said, lambda x: x.t).alias("descriptions"))
    done = ctx.table("actions").groupBy("investigation_id").agg(F.coalesce(F.max_by(F.when(F.col("status") == "completed", F.col("title")), F.when(F.col("status") == "completed", F.col("id"))), F.max_by("title", "id")).alias("last_action"))
    rows = ctx.table("investigations").withColumnRenamed("id", "investigation_id").join(e, "investigation_id", "left").join(a, "investigation_id", "left").join(done, "investigation_id", "left")
    none = F.array().cast("array<string>")
    found = F.slice(F.array_distinct(F.concat(F.coalesce("descriptions", none), F.coalesce("labels", none))), 1, factors)
    cause = F.when(F.col("ai_confidence") == "established", "CAUSE ESTABLISHED").when(F.col("ai_confidence") == "probable", "CAUSE PROBABLE").when(F.col("ai_confidence") == "suspected", "UNDER INVESTIGATION").otherwise("PENDING ANALYSIS")
    impact = F.when(F.coalesce(F.col("revenue_at_risk"), F.lit(0)) != 0, F.concat(F.lit("Estimated revenue at risk: $"), F.format_number(F.col("revenue_at_risk").cast("double"), 2), F.lit("."))).otherwise("Revenue impact not yet quantified.")
    return rows.select(
        "investigation_id", F.coalesce(F.nullif(F.col("evidence"), F.lit("")), F.lit("No supporting evidence collected yet.")).alias("evidence_text"),
        F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise("Multiple correlated signals detected across the investigation window.").alias("factors_text"), impact.alias("impact_text"), cause.alias("cause_label"), "last_action",
    )


def detection_rows(ctx: Context, limit: int = 10) -> DataFrame:
    """Up to ``limit`` rows of evidence of each investigation; those without any show what their primary anomaly's context holds."""
    from .evidence import shown_values
    from .metrics import primary_anomaly

    w = Window.partitionBy("investigation_id").orderBy("id")
    e = ctx.table("evidence").join(shown_values(ctx), "id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit).select("investigation_id", "k", "label", F.col("shown").alias("value"))
    first = primary_anomaly(ctx).select(F.col("anomaly_id").alias("id"))
    a = ctx.table("anomalies").where("context IS NOT NULL").join(first, "id", "left_semi").join(e.select("investigation_id"), "investigation_id", "left_anti")
    pairs = F.explode(F.map_entries(F.from_json("context", "map<string,string>"))).alias("p")
    a = a.select("investigation_id", pairs).select("investigation_id", F.initcap(F.replace(F.col("p.key"), F.lit("_"), F.lit(" "))).alias("label"), F.col("p.value").alias("value"))
    return e.unionByName(a.withColumn("k", F.row_number().over(Window.partitionBy("investigation_id").orderBy("label"))))


# Exports: fixed columns, labels joined in.


def export_anomalies(ctx: Context) -> DataFrame:
    label = rule_label(F.col("rule_type"))
    minute = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return ctx.table("anomalies").select(
        F.col("id").alias("ID"), F.col("severity").alias("Severity"), label.alias("Rule"), text("sku").alias("SKU"), text("description").alias("Description"), F.coalesce("investigation_status", F.lit("not_started")).alias("Investigation Status"),
        text("action_notes").alias("Action Notes"), text("resolution_notes").alias("Resolution Notes"), minute("detected_at").alias("Detected At"), minute("resolved_at").alias("Resolved At"),
    )


def export_investigations(ctx: Context) -> DataFrame:
    team = ctx.table("teams").select(F.col("id").alias("assigned_team_id"), F.col("name").alias("Team"))
    o = ctx.table("outcomes").select(F.col("investigation_id").alias("id"), F.col("revenue_recovered").alias("Observed Recovery"))
    rows = ctx.table("investigations").join(team, "assigned_team_id", "left").join(o, "id", "left")
    return rows.select(F.col("id").alias("ID"), F.col("title").alias("Title"), F.col("status").alias("Status"), F.col("priority").alias("Priority"), F.col("primary_sku").alias("SKU"), "Team", F.col("revenue_at_risk").alias("Revenue at Risk"), "Observed Recovery", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss").alias("Opened At"))


def export_actions(ctx: Context) -> DataFrame:
    i = ctx.table("investigations").select(F.col("id").alias("investigation_id"), F.col("title").alias("Investigation"))
    u = ctx.table("users").select(F.col("id").alias("assignee_id"), F.col("name").alias("assignee"))
    t = ctx.table("teams").select(F.col("id").alias("assigned_team_id"), F.col("name").alias("team"))
    sla = sla_level(F.col("status"), F.col("due_at"), ctx.clock())
    rows = ctx.table("actions").join(i, "investigation_id", "left").join(u, "assignee_id", "left").join(t, "assigned_team_id", "left")
    return rows.select(
        F.col("id").alias("ID"), F.col("title").alias("Title"), words(F.col("action_type")).alias("Type"), F.coalesce("Investigation", F.lit("—")).alias("Investigation"), words(F.col("priority")).alias("Priority"), words(F.col("status")).alias("Status"),
        F.coalesce("assignee", "team", F.lit("Unassigned")).alias("Assigned To"), F.coalesce(F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"), F.lit("—")).alias("Due At"), sla.alias("SLA Status"),
    )


def notified(ids: DataFrame) -> DataFrame:
    """Users to notify: each once, none that is null or zero."""
    return ids.where("user_id IS NOT NULL AND user_id <> 0").select("user_id").distinct()


def breakdown_components(ctx: Context) -> DataFrame:
    """The figures that each money card is made of: metric, component, value."""
    open_ = F.col("status").isin("open", "in_progress")
    number_ = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    risk = F.coalesce(F.col("revenue_at_risk"), F.lit(0))
    i = ctx.table("investigations").agg(number_(F.count_if(open_)).alias("open"), number_(F.count_if(open_ & (risk > 0))).alias("estimated"), number_(F.sum(F.when(open_, risk))).alias("at_risk"), number_(F.count_if(F.col("status").isin("resolved", "closed"))).alias("resolved"))
    month = F.col("recorded_at").cast("date") >= F.trunc(F.lit(ctx.now).cast("date"), "month")
    o = ctx.table("outcomes").agg(
        number_(F.count_if(month & (F.col("revenue_recovered") > 0))).alias("month"), number_(F.sum(F.when(month, F.col("revenue_recovered")))).alias("month_recovered"), number_(F.count("*")).alias("outcomes"), number_(F.sum("revenue_at_risk")).alias("outcome_risk"),
        number_(F.sum("revenue_recovered")).alias("recovered"), number_(F.count_if("was_false_positive")).alias("false"),
    )
    # The components of each card, in order.
    parts = {
        "revenue_at_risk": {"Open / in-progress investigations": "open", "With a revenue-at-risk estimate": "estimated", "Total revenue at risk": "at_risk"},
        "recovered_mtd": {"Outcomes recorded this month": "month", "Total observed recovery": "month_recovered"},
        "outcome_at_risk": {"Recorded outcomes": "outcomes", "Total revenue at risk": "outcome_risk"},
        "observed_recovery": {"Total revenue at risk": "outcome_risk", "Total observed recovery": "recovered", "Investigations resolved": "resolved"},
        "recovery_rate": {"Total observed recovery": "recovered", "Total revenue at risk": "outcome_risk", "Recovery rate": "rate"},
        "false_positives": {"Investigations closed as false positive": "false"},
    }
    row = i.crossJoin(o).withColumn("rate", pct(F.col("recovered"), F.col("outcome_risk")))  # rows of one
    each = [F.struct(F.lit(m).alias("metric"), F.lit(label).alias("component"), F.col(c).cast("double").alias("value")) for m, of in parts.items() for label, c in of.items()]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")
