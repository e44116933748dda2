"""Joins of intervals with points: buckets of days make an equality, exact bounds follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket: an interval of a month or two lies in two or three of them.
DAYS = 32


def bucket(day: Column, days: int = DAYS) -> Column:
    """The number of a day's bucket."""
    return F.floor(F.unix_date(day) / F.lit(days)).cast("int")


def pruned(points: DataFrame, intervals: DataFrame, low: str, high: str, at: str) -> DataFrame:
    """``points`` from the first day to the last that any interval has, by two scalar subqueries that reach the scan."""
    sound = intervals.where(F.col(low) <= F.col(high))
    first, last = (sound.agg(f.alias("day")).scalar() for f in (F.min(low), F.max(high)))
    return points.where((F.col(at) >= first) & (F.col(at) <= last))


def interval_join(intervals: DataFrame, points: DataFrame, on: str, low: str, high: str, at: str, days: int = DAYS) -> DataFrame:
    """Rows of ``intervals`` with each row of ``points`` of the same ``on`` and a day ``at`` from ``low`` to ``high``.

    An interval has a row for each bucket that it touches; the join is on key
    and bucket, so that one key's rows are dealt over tasks by time and a point
    meets only intervals of its bucket. Prune the points, and add them up by
    day, before. Intervals with a null or crossed bound have no points. Columns
    of ``points`` but the key must have names of their own.
    """
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low), days), bucket(F.col(high), days))))
    return spread.join(points.withColumn("_bucket", bucket(F.col(at), days)), [on, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")
