"""Keyed state without a table format: merge new rows into old ones and return the new state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..context import Context
from ..functions.columns import hours_between
from ..schema import RULES


def same_keys(keys: list[str], a: str = "o", b: str = "n"):
    """Null-safe equality of all keys."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def last_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str], overwrite: list[str]) -> DataFrame:
    """Old rows, with ``overwrite`` from the new row of the same key, and new rows of unseen keys; other old columns stay."""
    there = F.col("n._new").isNotNull()
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), same_keys(keys), "full_outer")
    columns = []
    for c in old.columns:
        if c in overwrite and c in new.columns:
            columns.append(F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in new.columns:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            columns.append(F.col(f"o.{c}").alias(c))
    return both.select(*columns)


def upsert_anomalies(open_: DataFrame, detections: DataFrame) -> DataFrame:
    """Anomalies after a run: action is ``update``, ``insert`` or ``stale``.

    Only undismissed rows take part. A detection with a null SKU is always
    inserted, so that the earlier row of its rule becomes stale. Of several
    detections with one key the one of the largest impact, then the largest
    context, stays.
    """
    keys = ["rule_type", "sku", "store_id"]
    live = open_.where("dismissed_at IS NULL")
    keyed = last_per_key(detections.where("sku IS NOT NULL"), keys, F.desc_nulls_last("revenue_impact"), F.desc("context"))
    loose = detections.where("sku IS NULL")
    live = last_per_key(live, keys, "id")
    both = live.alias("o").join(keyed.withColumn("_new", F.lit(True)).alias("n"), same_keys(keys), "full_outer")
    action = F.when(F.col("o.id").isNull(), "insert").when(F.col("n._new").isNull(), "stale").otherwise("update")
    merged = both.select(action.alias("action"), F.col("o.id").alias("id"), *(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys), F.coalesce("n.severity", "o.severity").alias("severity"), F.col("o.investigation_id").alias("investigation_id"))
    new = loose.select(F.lit("insert").alias("action"), F.lit(None).cast("long").alias("id"), *keys, "severity", F.lit(None).cast("long").alias("investigation_id"))
    return merged.unionByName(new)


def seed_settings(tenants: DataFrame, existing: DataFrame) -> DataFrame:
    """Missing (tenant_id, rule_type) settings, enabled."""
    rules = F.explode(F.array(*map(F.lit, RULES))).alias("rule_type")
    return tenants.select("tenant_id", rules).join(existing.select("tenant_id", "rule_type"), ["tenant_id", "rule_type"], "left_anti").withColumn("enabled", F.lit(True))


def quick_dismissals(ctx: Context) -> DataFrame:
    """Dismissed anomalies, with feedback where it took under ten minutes."""
    rows = ctx.table("anomalies").where("dismissed_at IS NOT NULL")
    return rows.select("id", "rule_type", "sku", (F.abs(hours_between(F.col("dismissed_at"), F.col("detected_at"))) * 60 < 10).alias("false_positive_feedback"))
