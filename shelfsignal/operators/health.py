"""Health of each dataset: freshness, completeness, validity and referential integrity, their score, warnings and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import hours_between

# Per dataset the table, the columns that must be filled, the date column, the hours it may be old,
# the least completeness and the largest rejection rate, both in percent.
DATASETS = {
    "sales": ("sales", ("sku", "quantity", "total_amount", "date"), "date", 48, 90, 5),
    "inventory": ("inventory", ("sku", "on_hand_qty"), "as_of_date", 48, 90, 5),
    "purchase_orders": ("purchase_orders", ("sku", "qty_ordered", "order_date"), "order_date", 72, 85, 5),
    "products": ("products", ("sku", "name", "unit_cost", "selling_price"), None, 720, 80, 5),
    "stores": ("stores", ("name",), None, 8760, 70, 5),
    "suppliers": ("suppliers", ("name",), None, 8760, 70, 5),
}
# Datasets whose SKUs must be products, and the names under which evidence gives a dataset as its source.
WITH_SKUS = ("sales", "inventory", "purchase_orders")
SOURCES = {
    "sales": ("sales_transactions", "sales"),
    "inventory": ("inventory_levels", "inventory", "inventory_snapshots"),
    "purchase_orders": ("purchase_orders", "po"),
    "products": ("products",),
    "suppliers": ("suppliers", "supplier"),
    "stores": ("stores",),
}
# Weights of the score.
WEIGHTS = {"freshness": 0.35, "completeness": 0.25, "validity": 0.25, "referential": 0.15}


def _round(c: Column, digits: int = 1) -> Column:
    return F.round(c + F.lit(1e-9), digits)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def measured(ctx: Context) -> DataFrame:
    """dataset, received, newest, orphans and shares (column, share of filled values); one pass over each table.

    Tables with SKUs are added up by SKU first, so that products are joined
    with a row for each SKU, not with each row.
    """
    products = ctx.table("products").select(F.col("sku").alias("known")).distinct()
    out = []
    for name, (table, columns, date, *_) in DATASETS.items():
        rows, by_sku = ctx.table(table), name in WITH_SKUS
        at = {k: c for k, c in (("date", date), ("changed", "updated_at" if "updated_at" in rows.columns else None)) if c}
        sums = [F.count("*").alias("n"), *(F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)), *(F.max(c).cast("timestamp").alias(k) for k, c in at.items())]
        if by_sku:
            rows = rows.groupBy("sku").agg(*sums).join(products, F.col("sku") == F.col("known"), "left")
            total, orphans = lambda c: F.coalesce(F.sum(c), F.lit(0)), F.coalesce(F.sum(F.when(F.col("sku").isNotNull() & F.col("known").isNull(), F.col("n"))), F.lit(0))
        else:
            rows, total, orphans = rows.agg(*sums), F.sum, F.lit(0).cast("long")
        newest = F.coalesce(*(F.max(k) for k in at)) if at else F.lit(None).cast("timestamp")
        shares = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.try_divide(total(f"n_{i}").cast("double"), total("n").cast("double")), F.lit(1.0)).alias("share")) for i, c in enumerate(columns)))
        out.append(rows.agg(F.lit(name).alias("dataset"), total("n").alias("received"), newest.alias("newest"), orphans.alias("orphans"), shares.alias("shares")))
    return _union(out)


def thresholds(ctx: Context) -> DataFrame:
    """dataset, max_hours, min_completeness, max_rejection: the tenant's settings over the default ones."""
    spark = ctx.table("products").sparkSession
    default = spark.createDataFrame([(name, d[3], float(d[4]), float(d[5])) for name, d in DATASETS.items()], "dataset string, max_hours int, min_completeness double, max_rejection double")
    if "health_settings" not in ctx.tables:
        return default
    s = ctx.table("health_settings").select("dataset", "freshness_max_hours", "completeness_min_pct", "rejection_max_pct")
    pick = lambda own, other: F.coalesce(F.col(own).cast("double"), other)
    return default.join(s, "dataset", "left").select("dataset", pick("freshness_max_hours", "max_hours").cast("int").alias("max_hours"), pick("completeness_min_pct", "min_completeness").alias("min_completeness"), pick("rejection_max_pct", "max_rejection").alias("max_rejection"))


def latest_runs(ctx: Context) -> DataFrame:
    """The latest import of each dataset, whatever its outcome."""
    last = F.max_by(F.struct("id", "rows_processed", "rows_imported", "rows_failed", "validation_score", F.coalesce("completed_at", "started_at").alias("ingested_at")), "id")
    return ctx.table("runs").groupBy(F.col("data_type").alias("dataset")).agg(last.alias("run")).select("dataset", "run.*")


def completeness(ctx: Context) -> DataFrame:
    """Filled share of every column that must be filled, in percent."""
    return measured(ctx).select("dataset", "received", F.explode("shares").alias("s")).select("dataset", "received", "s.column", _round(F.col("s.share") * 100).alias("pct"))


def validity(ctx: Context) -> DataFrame:
    """Of the latest run: its score, else imported rows of processed ones; accepted and rejected rows."""
    return latest_runs(ctx).where("rows_processed > 0").select("dataset", _validity().alias("validity"), F.col("rows_imported").alias("accepted"), F.col("rows_failed").alias("rejected"))


def _validity() -> Column:
    share = _round(F.col("rows_imported").cast("double") / F.col("rows_processed").cast("double") * 100)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("validation_score").cast("double"), share)))


def _plain(c: Column) -> Column:
    """A figure without a zero after the point."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _parts(ctx: Context) -> DataFrame:
    """What the score is made of, a row a dataset. Dates are held against the as-of day, imports against the clock."""
    rows = measured(ctx).join(thresholds(ctx), "dataset").join(latest_runs(ctx), "dataset", "left")
    age = F.coalesce(F.abs(hours_between(F.lit(ctx.as_of).cast("timestamp"), F.col("newest"))), F.abs(hours_between(ctx.clock(), F.col("ingested_at"))))
    rows = rows.withColumn("hours", F.round(age + 1e-9, 0).cast("int"))
    over = (F.col("hours") - F.col("max_hours")) / F.greatest(F.col("max_hours") * 2, F.lit(1)) * 100
    ran = F.coalesce(F.col("rows_processed") > 0, F.lit(False))
    rows = rows.withColumns(
        {
            "freshness": F.when(F.col("hours").isNull(), 0.0).when(F.col("hours") <= F.col("max_hours"), 100.0).otherwise(_round(F.greatest(F.lit(0.0), 100 - over))),
            "completeness": _round(F.aggregate(F.col("shares.share"), F.lit(0.0), lambda a, x: a + x) / F.size("shares") * 100),
            "validity": F.when(ran, _validity()).otherwise(100.0),
            "accepted": F.when(ran, F.col("rows_imported")).otherwise(F.col("received")),
            "rejected": F.when(ran, F.col("rows_failed")).otherwise(0),
            "referential": F.when(F.col("received") > 0, F.greatest(F.lit(0.0), _round((1 - F.col("orphans") / F.col("received")) * 100))).otherwise(100.0),
        }
    )
    return rows.withColumn("rejection", _round(F.coalesce(F.try_divide(F.col("rejected").cast("double"), F.col("received").cast("double")), F.lit(0.0)) * 100))


def freshness(ctx: Context) -> DataFrame:
    return _parts(ctx).select("dataset", "hours", "max_hours", "freshness")


def referential(ctx: Context) -> DataFrame:
    """Rows whose SKU is no product."""
    return _parts(ctx).where(F.col("dataset").isin(*WITH_SKUS)).select("dataset", "received", "orphans", "referential")


def snapshots(ctx: Context) -> DataFrame:
    """Score, status, figures and warnings (level, message) of each dataset; without rows no score."""
    rows, label = _parts(ctx), F.concat(F.upper(F.substring("dataset", 1, 1)), F.substring("dataset", 2, 100))
    warn = lambda when, level, *text: F.when(when, F.struct(level.alias("level"), F.concat(*text).alias("message")))
    mild, hours = F.lit("warning"), F.col("hours")
    found = F.array_compact(
        F.array(
            warn(hours > F.col("max_hours"), F.when(hours > F.col("max_hours") * 2, "critical").otherwise("warning"), label, F.lit(" data is "), hours.cast("string"), F.lit(" hours old (threshold "), F.col("max_hours").cast("string"), F.lit("h). Conclusions relying on it may be incomplete.")),
            warn(F.col("completeness") < F.col("min_completeness"), mild, label, F.lit(" completeness "), _plain(F.col("completeness")), F.lit("% is below the "), _plain(F.col("min_completeness")), F.lit("% target.")),
            warn(F.col("rejection") > F.col("max_rejection"), mild, F.lit("Rejection rate "), _plain(F.col("rejection")), F.lit("% exceeds the "), _plain(F.col("max_rejection")), F.lit("% threshold (possible rejection spike).")),
            warn(F.col("orphans") > 0, F.when(F.col("referential") < 90, "critical").otherwise("warning"), F.col("orphans").cast("string"), F.lit(" "), F.col("dataset"), F.lit(" record(s) reference a SKU with no matching product.")),
        )
    )
    none = F.array(F.struct(F.lit("critical").alias("level"), F.concat(F.lit("No "), F.col("dataset"), F.lit(" data has been ingested yet.")).alias("message")))
    empty = F.col("received") == 0
    score = _round(sum((F.lit(w) * F.col(k) for k, w in WEIGHTS.items()), F.lit(0.0)))
    rows = rows.withColumn("score", F.when(~empty, score)).withColumn("warnings", F.when(empty, none).otherwise(found))
    status = F.when(empty, "no_data").when(F.array_contains(F.col("warnings.level"), "critical") | (F.col("score") < 60), "critical").when((F.col("score") < 85) | (F.size("warnings") > 0), "warning").otherwise("healthy")
    there = lambda c: F.when(~empty, F.col(c)).alias(c)
    zero = lambda c: F.when(empty, 0).otherwise(F.col(c)).cast("long").alias(c)
    return rows.select("dataset", status.alias("status"), "score", there("hours"), there("completeness"), there("validity"), "received", zero("accepted"), zero("rejected"), "warnings", there("newest"))


def warnings(ctx: Context) -> DataFrame:
    """The warnings of all datasets, a row each."""
    return snapshots(ctx).select("dataset", F.explode("warnings").alias("w")).select("dataset", "w.level", "w.message")


def scores(ctx: Context) -> DataFrame:
    return snapshots(ctx).select("dataset", "status", "score", "hours", "completeness", "validity", "received", "accepted", "rejected", F.size("warnings").cast("long").alias("n_warnings"))


def overall(ctx: Context) -> DataFrame:
    """Critical if any dataset is, or has no data; the mean score of those that have one."""
    any_ = lambda *names: F.coalesce(F.bool_or(F.col("status").isin(*names)), F.lit(False))
    row = snapshots(ctx).agg(any_("critical", "no_data").alias("critical"), any_("warning").alias("warning"), F.avg("score").alias("score"), F.count("*").alias("datasets"), F.sum(F.size("warnings")).alias("n_warnings"))
    return row.select(F.when(F.col("critical"), "critical").when(F.col("warning"), "warning").otherwise("healthy").alias("status"), _round(F.col("score")).alias("score"), "datasets", F.col("n_warnings").cast("long").alias("n_warnings"))


def affected_investigations(ctx: Context, dataset: str, limit: int = 25) -> DataFrame:
    """The newest open investigations with evidence from ``dataset``."""
    e = ctx.table("evidence").where(F.col("source").isin(*SOURCES[dataset])).select(F.col("investigation_id").alias("id"))
    return ctx.table("investigations").where(F.col("status").isin("open", "in_progress")).join(e, "id", "left_semi").orderBy(F.desc("opened_at"), "id").limit(limit).select("id", "status", "priority")


def evidence_caveats(ctx: Context) -> DataFrame:
    """For each investigation the unhealthy datasets that its evidence rests on, with their age."""
    names = F.create_map(*(F.lit(x) for name, sources in SOURCES.items() for s in sources for x in (s, name)))
    ill = snapshots(ctx).where(F.col("status") != "healthy").select("dataset", F.coalesce(F.concat(F.col("hours").cast("string"), F.lit("h old")), F.lit("unavailable")).alias("age"))
    e = ctx.table("evidence").select("investigation_id", F.try_element_at(names, F.col("source")).alias("dataset")).where("dataset IS NOT NULL").distinct()
    return e.join(F.broadcast(ill), "dataset").groupBy("investigation_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("dataset", F.lit(" data is "), "age"))), "; ").alias("caveats"))  # six datasets at most


def recipients(ctx: Context) -> DataFrame:
    """Administrators, who are told of critical datasets."""
    return ctx.table("users").where("is_admin").agg(F.array_join(F.sort_array(F.collect_list("email")), ",").alias("emails"))
