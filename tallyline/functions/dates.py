"""Business-day calendar and date expressions, always from an explicit run date."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.errors import ConfigError
from tallyline.functions.naming import date_pattern


def active_holidays(holidays: Iterable[str | dict] | None) -> list[date]:
    """ISO strings, or ``{"active", "name", "date"}`` entries; inactive ones are dropped."""
    found = set()
    for entry in holidays or []:
        if isinstance(entry, dict):
            if not entry.get("active", True) or not entry.get("date"):
                continue
            entry = entry["date"]
        found.add(entry if isinstance(entry, date) else date.fromisoformat(entry.strip()))
    return sorted(found)


def previous_business_day(day: date, holidays: Iterable[str | dict] | None = None) -> date:
    """The day before, skipping active holidays only: deliveries come on weekends too."""
    closed = set(active_holidays(holidays))
    day -= timedelta(days=1)
    while day in closed:
        day -= timedelta(days=1)
    return day


def _longest_run(days: list[date]) -> int:
    """Length of the longest run of consecutive days in a sorted list."""
    longest = run = 0
    last = None
    for day in days:
        run = run + 1 if last is not None and day - last == timedelta(days=1) else 1
        longest, last = max(longest, run), day
    return longest


def previous_business_day_of(day: Column, holidays: Iterable[str | dict] | None = None) -> Column:
    """Column form of ``previous_business_day``.

    A run of n consecutive holidays is the most that can be skipped, so n + 1
    candidate days decide the answer.
    """
    closed = active_holidays(holidays)
    if not closed:
        return F.date_sub(day, 1)
    tries = [F.date_sub(day, back) for back in range(1, _longest_run(closed) + 2)]
    return F.coalesce(*[F.when(~candidate.isin(closed), candidate) for candidate in tries])


def expected_calendar(
    spark: SparkSession, first: date, last: date, holidays: Iterable[str | dict] | None = None
) -> DataFrame:
    """One row ``day`` per delivery day from ``first`` to ``last`` inclusive."""
    days = spark.range((last - first).days + 1).select(
        F.date_add(F.lit(first), F.col("id").cast("int")).alias("day")
    )
    closed = active_holidays(holidays)
    return days.filter(~F.col("day").isin(closed)) if closed else days


def on_run_date(expression: str, run_date: date | None) -> str:
    """An SQL expression with ``current_date()`` and ``load_date()`` as the run date.

    A run repeated for an old day then gives the same records.
    """
    if run_date is None:
        return expression
    return re.sub(r"\b(?:current_date|load_date)\s*\(\s*\)", f"date'{run_date:%Y-%m-%d}'", expression, flags=re.I)


def _render(day: date, pattern: str) -> str:
    """Format a date with a Spark pattern made of yyyy, yy, MM, dd and separators."""
    parts = {"yyyy": f"{day:%Y}", "yy": f"{day:%y}", "MM": f"{day:%m}", "dd": f"{day:%d}"}
    if re.search(r"[A-Za-z]", re.sub("yyyy|yy|MM|dd", "", pattern)):
        raise ConfigError(f"unsupported date pattern in a path: {pattern!r}")
    return re.sub("yyyy|yy|MM|dd", lambda m: parts[m.group(0)], pattern)


def partition_value(expression: str | None, run_date: date) -> str:
    """A path-date expression as text; anything that is no date expression is a literal."""
    text = (expression or "").strip()
    low = re.sub(r"\s+", "", text.lower())
    if low in ("load_date()", "current_date()"):
        return f"{run_date:%Y%m%d}"
    if back := re.fullmatch(r"date_sub\(current_date\(\),(\d+)\)", low):
        return f"{run_date - timedelta(days=int(back.group(1))):%Y%m%d}"
    if low == "last_day(current_date())":
        end = calendar.monthrange(run_date.year, run_date.month)[1]
        return f"{run_date.replace(day=end):%Y%m%d}"
    if low.startswith("date_format(current_date(),"):
        pattern = re.search(r"""['"]([^'"]+)['"]""", text)
        if pattern is None:
            raise ConfigError(f"no pattern in {text!r}")
        return _render(run_date, date_pattern(pattern.group(1)))
    return text
