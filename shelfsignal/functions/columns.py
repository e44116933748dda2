"""Column expressions: guarded division, ranks, rounding, file-value parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIORITIES, RULE_LABELS, SEVERITIES
from .dates import natural_date


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b in double precision; null where b is null or zero."""
    return F.try_divide(a.cast("double") * F.lit(float(scale)), b.cast("double"))


def rounded(c: Column, digits: int = 4) -> Column:
    return F.round(c.cast("double"), digits)


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    """1 for the first of ``order`` and so on; null for others."""
    out = F.lit(None).cast("int")
    for i, value in enumerate(order, 1):
        out = F.when(c == value, i).otherwise(out)
    return out


def severity_rank(c: Column) -> Column:
    return rank_of(c, SEVERITIES)


def priority_rank(c: Column) -> Column:
    return rank_of(c, PRIORITIES)


def priority_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PRIORITIES)), rank.cast("int"))


def words(c: Column) -> Column:
    """A key as it is shown: underscores are spaces, words begin with a capital."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def rule_label(c: Column) -> Column:
    """What a rule is called; an unknown one by its key."""
    labels = F.create_map(*(F.lit(x) for pair in RULE_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, c), c)


def sla_level(status: Column, due: Column, now: Column) -> Column:
    """The state of an action's deadline: none without one or once it is over, then overdue, critical under 4 hours, warning under a day, ok."""
    left = hours_between(due, now)
    live = ~F.coalesce(status, F.lit("")).isin("completed", "cancelled")
    return F.when(~live | due.isNull(), "none").when(left < 0, "overdue").when(left < 4, "critical").when(left < 24, "warning").otherwise("ok")


def impact_severity(impact: Column) -> Column:
    return F.when(impact >= 10000, "high").when(impact >= 2000, "medium").otherwise("low")


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def number(c: Column) -> Column:
    """A number once all but digits, points and minus signs are taken out; null if none is left."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def is_blank(c: Column, strict_zero: bool = False) -> Column:
    """Missing in a file: null, empty and, unless ``strict_zero``, the text "0"."""
    blank = c.isNull() | (c == "")
    return blank if strict_zero else blank | (c == "0")


#: Accepted date formats, in order of preference.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy")


def parsed_date(c: Column, today: Column | None = None) -> Column:
    """The date that the first fitting format reads, else what the text means in words; null if it means none."""
    return F.coalesce(F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS)).cast("date"), natural_date(c, today))


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 2))


def short_money(c: Column) -> Column:
    """$950, $1.2K, $3.45M."""
    c = c.cast("double")
    return F.when(c >= 1e6, F.format_string("$%.2fM", c / 1e6)).when(c >= 1e3, F.format_string("$%.1fK", c / 1e3)).otherwise(F.format_string("$%.0f", c))
