"""Dates as people write them: a small grammar of native expressions.

Read are, in any case and with any time of day behind them: year-month-day and
the same without signs, month/day/year, day-month-year and day.month.year,
dates with the name of a month (a weekday before, an ordinal's ending, a comma
and a missing day are allowed), seconds since 1970 after an @; and, where a day
counts as today: dates without a year, today, yesterday, tomorrow, weekdays,
counts of days, weeks, months and years from today, next and last ones, and
the first or last day of a month. A day that its month lacks runs over into
the next month, as does a month added to such a day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months and weekdays, numbers that are written out, and units.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
COUNTS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
_MONTHS = "|".join(m[:3] for m in MONTHS)
_STEPS = _MONTHS + "|" + "|".join(d[:3] for d in WEEKDAYS) + "|day|week|fortnight|month|year|tomorrow|now|noon|night"
_TIME = r"(?:[ t]+(?:at )?\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?| \d{1,2}(?= ?[ap]\.?m\.?))(?: ?[ap]\.?m\.?)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?$"


def _table(pairs: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _lookup(pairs: dict[str, int], name: Column) -> Column:
    return F.try_element_at(_table(pairs), name)


_MONTH = {n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
_WEEKDAY = {n: i for i, d in enumerate(WEEKDAYS) for n in (d, d[:3])} | {"tues": 1, "wednes": 2, "thur": 3, "thurs": 3}
_COUNT = {"next": 1, "last": -1, "previous": -1, "this": 0, "a": 1, "an": 1} | {n: i for i, n in enumerate(COUNTS, 1)}


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, if month and day can be ones; a day that the month lacks runs over."""
    return F.when(month.between(1, 12) & day.between(1, 31) & (year > 0), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))


def _add_months(day: Column, months: Column) -> Column:
    """As a calendar that runs over: January 31 and a month is a day in March."""
    return F.date_add(F.add_months(F.trunc(day, "month"), months), F.dayofmonth(day) - 1)


def natural_date(c: Column, today: Column | None = None) -> Column:
    """The date that a text means, seen from ``today`` where it is given; null for any other text.

    The text is made plain once and handed to the patterns as a variable, which
    also keeps their many branches out of generated code.
    """
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    s = F.trim(F.regexp_replace(s, _TIME, ""))
    s = F.regexp_replace(s, r"(?<=\d)(?:st|nd|rd|th)\b", "")
    s = F.regexp_replace(s, rf"^(?:{'|'.join(sorted(_WEEKDAY, key=len, reverse=True))})\.?,? (?=.*\d)", "")
    return F.get(F.transform(F.array(s), lambda plain: _meant(plain, today)), F.lit(0))


def _meant(s: Column, today: Column | None) -> Column:
    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract(s, pattern, k)

    def number(pattern: str, k: int) -> Column:
        return group(pattern, k).try_cast("int")

    def year(pattern: str, k: int) -> Column:
        """A year of two digits is one from 1970 to 2069."""
        n = number(pattern, k)
        return F.when(F.length(group(pattern, k)) == 2, F.when(n < 70, n + 2000).otherwise(n + 1900)).otherwise(n)

    def named(pattern: str, k: int) -> Column:
        return _lookup(_MONTH, group(pattern, k))

    def numeric(pattern: str, y: int, m: int, d: int) -> Column:
        return F.when(s.rlike(pattern), _date(year(pattern, y), number(pattern, m), number(pattern, d)))

    one = F.lit(1)
    day_first, name_first, no_day, year_first = r"^(\d{1,2})[ .-]*([a-z]+)\.?[ .,-]*(\d{4})$", r"^([a-z]+)\.?[ .-]*(\d{1,2})[ ,.-]+(\d{4})$", r"^([a-z]+)\.?[ .,-]*(\d{4})$", r"^(\d{4})[ -]([a-z]+)[ -](\d{1,2})$"
    numbers = [
        numeric(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 1, 2, 3), numeric(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3), numeric(r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", 3, 1, 2), numeric(r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4})$", 3, 2, 1),
        F.date_from_unix_date(F.floor(F.regexp_extract(s, r"^@(-?\d{1,11})$", 1).try_cast("bigint") / 86400).cast("int")),
    ]
    named_ones = [
        _date(year(day_first, 3), named(day_first, 2), number(day_first, 1)), _date(year(name_first, 3), named(name_first, 1), number(name_first, 2)),
        _date(year(no_day, 2), named(no_day, 1), one), _date(year(year_first, 1), named(year_first, 2), number(year_first, 3)),
    ]
    steps = F.lit(None).cast("date") if today is None else F.when(s.rlike(_STEPS), F.coalesce(*_relative(s, group, number, named, today)))
    # most texts that mean no date are told by one or two patterns
    return F.when(s.rlike("[a-z]"), F.coalesce(F.when(s.rlike(_MONTHS), F.coalesce(*named_ones)), steps)).when(s.rlike(r"^[@\d]"), F.coalesce(*numbers))


def _relative(s: Column, group, number, named, today: Column) -> list[Column]:
    day_month, month_day, month = r"^(\d{1,2})[ .-]?([a-z]+)$", r"^([a-z]+)[ .-]?(\d{1,2})$", r"^([a-z]+)$"
    this_year, one = F.year(today), F.lit(1)
    word = _lookup({"today": 0, "now": 0, "midnight": 0, "noon": 0, "yesterday": -1, "tomorrow": 1}, s)
    step = r"^([+-]? ?\d{1,5}|next|last|previous|this|an?|" + "|".join(COUNTS) + r") ?(day|week|fortnight|month|year)s?( ago)?$"
    n = F.coalesce(_lookup(_COUNT, group(step, 1)), F.replace(group(step, 1), F.lit(" "), F.lit("")).try_cast("int")) * F.when(group(step, 3) == "", 1).otherwise(-1)
    unit = group(step, 2)
    moved = F.when(unit == "day", F.date_add(today, n)).when(unit == "week", F.date_add(today, 7 * n)).when(unit == "fortnight", F.date_add(today, 14 * n)).when(unit == "month", _add_months(today, n)).when(unit == "year", _add_months(today, 12 * n))
    named_day = r"^(next |last |previous |this )?([a-z]+)$"
    which, weekday = group(named_day, 1), _lookup(_WEEKDAY, group(named_day, 2))
    ahead = F.pmod(weekday - F.weekday(today), F.lit(7))  # 0 is today
    on_day = F.when(which == "next ", F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead))).when(which.isin("last ", "previous "), F.date_sub(today, F.when(ahead == 0, 7).otherwise(7 - ahead))).otherwise(F.date_add(today, ahead))
    edge = r"^(first|last) day of (?:(next|last|previous|this) month|([a-z]+)(?: (\d{4}))?)$"
    begin = F.coalesce(F.add_months(F.trunc(today, "month"), _lookup(_COUNT, group(edge, 2))), _date(F.coalesce(number(edge, 4), this_year), named(edge, 3), one))
    return [
        F.date_add(today, word), moved, F.when(weekday.isNotNull(), on_day), F.when(group(edge, 1) == "first", begin).when(group(edge, 1) == "last", F.last_day(begin)),
        _date(this_year, named(day_month, 2), number(day_month, 1)), _date(this_year, named(month_day, 1), number(month_day, 2)), _date(this_year, named(month, 1), F.dayofmonth(today)),
    ]
