"""Scalar expressions: text and date coercion, severities, weights and message parts."""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date formats, in the order tried.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/M/d", "d-MMM-yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")
#: In place of month before day, where a column shows that its days come first.
DAY_FIRST = {"M/d/yyyy": "d/M/yyyy"}
WEEK_LABEL = r"(?i)w(?:m|k)?\s*(?:week\s*)?(\d{2})(\d{2})"


@dataclass(frozen=True)
class WeekCalendar:
    """How a retailer's week labels count: two digits of fiscal year, two of the week, from the Monday on or before the year's start."""

    label_format: str = "yyww"
    century: int = 2000
    fiscal_year_start_month: int = 1
    fiscal_year_start_day: int = 1

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, given: dict | None) -> WeekCalendar:
        """Unknown keys are ignored."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (given or {}).items() if k in names})

    def week1_monday(self, year: int) -> dt.date:
        start = dt.date(year, self.fiscal_year_start_month, self.fiscal_year_start_day)
        return start - dt.timedelta(days=start.weekday())


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def number(col: Column) -> Column:
    """Thousands commas go; what is no number is null."""
    return F.trim(F.replace(col.cast("string"), F.lit(","), F.lit(""))).try_cast("double")


def day(col: Column, day_first: bool = False) -> Column:
    """The first of DATE_FORMATS that fits, else null; days before months where both are numbers, if ``day_first``."""
    text = F.trim(col.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(DAY_FIRST.get(f, f) if day_first else f)) for f in DATE_FORMATS]).cast("date")


def label_week(col: Column, calendar: WeekCalendar = WeekCalendar()) -> Column:
    """Monday of a label like "WM Week 2503"; null for anything else. Week 0 counts as week 1."""
    text = F.trim(col.cast("string"))
    year = F.regexp_extract(text, WEEK_LABEL, 1).try_cast("int") + calendar.century
    week = F.regexp_extract(text, WEEK_LABEL, 2).try_cast("int")
    start = monday(F.make_date(year, F.lit(calendar.fiscal_year_start_month), F.lit(calendar.fiscal_year_start_day)))
    return F.date_add(start, (7 * F.greatest(F.lit(0), week - 1)).cast("int"))


def week(col: Column, calendar: WeekCalendar = WeekCalendar(), day_first: bool = False) -> Column:
    """Monday of a label or date, mixed formats in one column."""
    return F.when(F.regexp_extract(F.trim(col.cast("string")), WEEK_LABEL, 1) != "", label_week(col, calendar)).otherwise(monday(day(col, day_first)))


def severity(ratio: Column) -> Column:
    return F.when(ratio >= 2.0, "high").when(ratio >= 1.0, "medium").otherwise("low")


def sensed_weight(lag: Column, horizon: int) -> Column:
    """0.9 for the next two weeks, then falling in a line to 0.2 at the horizon, never outside 0.15 to 1."""
    span = max(2, horizon) - 2
    later = 0.9 - 0.7 * (lag - 2) / float(span) if span else F.lit(0.9)
    return F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.when(lag <= 2, 0.9).otherwise(later)))


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.0f%%", F.bround(x * 100).cast("double"))


def percent(x: Column) -> Column:
    return F.format_string("%.0f%%", F.bround(x * 100).cast("double"))


def short_number(n: Column) -> Column:
    """1234567 as 1.2M, 12345 as 12.3K, 123 as 123."""
    return F.when(F.abs(n) >= 1e6, F.format_string("%.1fM", n / 1e6)).when(F.abs(n) >= 1e3, F.format_string("%.1fK", n / 1e3)).otherwise(F.format_string("%.0f", n))
