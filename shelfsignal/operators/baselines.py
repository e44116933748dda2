"""Adaptive baselines: mean and population deviation of daily sales, prices and location totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import Context
from ..schema import BASELINE_DAYS, BASELINE_SAMPLES, BASELINE_STDDEV, SENSITIVITY, SENSITIVITY_MAX, SENSITIVITY_STEP


def _recent(ctx: Context) -> DataFrame:
    return ctx.table("sales").where(F.col("date") >= ctx.day(BASELINE_DAYS))


def _stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, stddev and sample_count per key, of the samples that make a baseline admissible."""
    v = F.col(value).cast("double")
    out = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.count("*").alias("sample_count"))
    return out.where((F.col("sample_count") >= BASELINE_SAMPLES) & (F.col("stddev") >= BASELINE_STDDEV))


def _daily(ctx: Context) -> DataFrame:
    """Units of the last 90 days by SKU, store, location and day, dealt by SKU: what all unit baselines are summed up from.

    The first exchange adds up on the map side, so a frequent SKU has no more
    than a row a day and place when it is dealt by SKU.
    """
    q = F.col("quantity")
    rows = _recent(ctx).where("sku IS NOT NULL").groupBy("sku", "store_id", "location", "date").agg(F.sum("quantity").alias("units"), F.sum(F.when(q > 0, q)).alias("sold"))
    return rows.repartition("sku")


#: The groupings of one pass: their samples are days of a SKU, days of a SKU at a store, locations of a SKU.
_SETS = ("sku", "store", "location")


def units(ctx: Context) -> DataFrame:
    """All unit baselines in one pass: kind (of ``_SETS``), sku, store_id, mean, stddev and sample_count.

    One scan and one exchange of raw rows; each daily row stands for itself in
    up to three groupings, and since all keys hold the SKU by which rows are
    dealt, samples and their statistics need no further exchange.
    """
    no_day, no_store, no_place = F.lit(None).cast("date"), F.lit(None).cast("long"), F.lit(None).cast("string")
    one = lambda kind, when, day, store, place, value: F.when(when, F.struct(F.lit(kind).alias("kind"), day.alias("day"), store.cast("long").alias("store_id"), place.cast("string").alias("place"), value.alias("v")))
    sold, store, place, day = F.col("sold"), F.col("store_id"), F.col("location"), F.col("date")
    sets = [
        one("sku", sold.isNotNull() & day.isNotNull(), day, no_store, no_place, sold), one("store", sold.isNotNull() & store.isNotNull(), day, store, no_place, sold),
        one("location", place.isNotNull(), no_day, no_store, place, F.col("units")),
    ]
    rows = _daily(ctx).select("sku", F.explode(F.array_compact(F.array(*sets))).alias("x")).select("sku", "x.*")
    samples = rows.groupBy("sku", "kind", "store_id", "place", "day").agg(F.sum("v").alias("v"))
    return _stats(samples, ["sku", "kind", "store_id"], "v")


def daily_sales(ctx: Context, by_store: bool = False) -> DataFrame:
    """Units per selling day and SKU (and store), of positive quantities in the last 90 days."""
    keys = ["sku", "store_id"] if by_store else ["sku"]
    days = _recent(ctx).where("quantity > 0").dropna(subset=keys).groupBy(*keys, "date").agg(F.sum("quantity").alias("units"))
    return _stats(days, keys, "units")


def unit_price(ctx: Context) -> DataFrame:
    """Each priced transaction of the last 90 days is a sample."""
    return _stats(_recent(ctx).where(F.col("unit_price") > 0), ["sku"], "unit_price")


def location_quantity(ctx: Context) -> DataFrame:
    """90-day units per SKU and location; locations are the samples."""
    places = _recent(ctx).where("location IS NOT NULL").groupBy("sku", "location").agg(F.sum("quantity").alias("units"))
    return _stats(places, ["sku"], "units")


# Which rules each kind of baseline serves, and the metric it is kept under.
_SERVES = {"sku": (("sales_spike", "sales_drop"), "daily_qty"), "store": (("sales_spike", "sales_drop"), "daily_qty"), "location": (("store_outlier",), "location_qty")}


def compute(ctx: Context) -> DataFrame:
    """All baselines: rule_type, metric, sku, store_id, mean, stddev, sample_count."""
    rules = F.create_map(*(x for kind, (names, metric) in _SERVES.items() for x in (F.lit(kind), F.struct(F.array(*map(F.lit, names)).alias("rules"), F.lit(metric).alias("metric")))))
    rows = units(ctx).withColumn("serves", rules[F.col("kind")]).withColumns({"rule_type": F.explode("serves.rules"), "metric": F.col("serves.metric")})
    prices = unit_price(ctx).withColumns({"store_id": F.lit(None).cast("long"), "rule_type": F.lit("price_anomaly"), "metric": F.lit("unit_price")})
    columns = ["rule_type", "metric", "sku", "store_id", "mean", "stddev", "sample_count"]
    return rows.select(columns).unionByName(prices.select(columns))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New statistics over old ones; rows without new ones stay, sensitivity and false positives are kept."""
    keys = ["rule_type", "metric", "sku", "store_id"]
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    both = old.alias("o").join(new.alias("n"), on, "full_outer")
    return both.select(
        *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*keys, "mean", "stddev", "sample_count"]),
        F.coalesce("o.sensitivity_multiplier", F.lit(SENSITIVITY)).alias("sensitivity_multiplier"),
        F.coalesce("o.fp_count", F.lit(0)).alias("fp_count"),
    )


def lookup(keys: DataFrame, store_level: DataFrame, wide: DataFrame) -> DataFrame:
    """``keys`` (sku, store_id) with the store's baseline, or else the SKU's; scope says which."""
    s = store_level.select("sku", "store_id", *(F.col(c).alias(f"s_{c}") for c in ("mean", "stddev", "sample_count")))
    w = wide.select("sku", *(F.col(c).alias(f"w_{c}") for c in ("mean", "stddev", "sample_count")))
    out = keys.join(s, ["sku", "store_id"], "left").join(w, "sku", "left")
    scope = F.when(F.col("s_mean").isNotNull(), "store").when(F.col("w_mean").isNotNull(), "retailer")
    return out.select("sku", "store_id", *(F.coalesce(f"s_{c}", f"w_{c}").alias(c) for c in ("mean", "stddev", "sample_count")), scope.alias("scope"))


def z_score(value, mean, stddev):
    """0 where the deviation isn't positive."""
    return F.when(stddev > 0, F.try_divide(value - mean, stddev)).otherwise(F.lit(0.0))


def false_positive_feedback(ctx: Context) -> DataFrame:
    """rule_type, sku, sensitivity_multiplier and fp_count after all false positives among the anomalies."""
    n = ctx.table("anomalies").where("is_false_positive AND sku IS NOT NULL").groupBy("rule_type", "sku").agg(F.count("*").alias("fp_count"))
    return n.withColumn("sensitivity_multiplier", F.least(F.lit(SENSITIVITY_MAX), SENSITIVITY + SENSITIVITY_STEP * F.col("fp_count")))
