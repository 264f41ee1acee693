"""Business-day counts, the date dimension and the business calendar.

Business days are counted by a closed form of the two dates alone: whole weeks and
weekdays up to each date, less the holidays up to it. No table is joined, no bounds of
the dates have to be known, and any date has a count. The calendar table serves the SQL
path, so that the two paths count by different means.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline import config

# A Monday, from which weekdays are counted.
MONDAY = dt.date(1970, 1, 5)


def is_weekend(date: Column) -> Column:
    """Saturday or Sunday (``weekday`` counts Monday as 0)."""
    return F.weekday(date) >= 5


def weekdays_through(date: Column) -> Column:
    """Weekdays from a fixed Monday up to and including ``date``."""
    days = F.datediff(date, F.lit(MONDAY))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))


def _observed(year: Column, month: int, day: int) -> Column:
    """A fixed holiday, on Friday or Monday where it falls on a weekend."""
    date = F.make_date(year, F.lit(month), F.lit(day))
    shift = F.when(F.weekday(date) == 5, -1).when(F.weekday(date) == 6, 1).otherwise(0)
    return F.date_add(date, shift)


def _nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    if nth < 0:
        end = F.last_day(first)
        return F.date_sub(end, F.pmod(F.weekday(end) - (weekday - 1), F.lit(7)))
    return F.date_add(first, F.pmod(F.lit(weekday - 1) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def federal_holidays_through(date: Column) -> Column:
    """Observed federal holidays up to and including ``date``, from a fixed start.

    Every holiday is observed on one weekday, so a year has as many as there are rules;
    only those of the date's own year are compared, and the next New Year's Day, which
    may be observed on 31 December.
    """
    year = F.year(date)

    def passed(holiday: Column) -> Column:
        return (holiday <= date).cast("int")

    before = year * (len(config.FIXED_HOLIDAYS) + len(config.FLOATING_HOLIDAYS))
    own = [passed(_observed(year, month, day)) for month, day in config.FIXED_HOLIDAYS]
    own += [passed(_nth_weekday(year, *rule)) for rule in config.FLOATING_HOLIDAYS]
    for since, month, day in config.LATER_HOLIDAYS:
        before = before + F.greatest(year - since, F.lit(0))
        own.append(F.when(year >= since, passed(_observed(year, month, day))).otherwise(0))
    next_year = F.date_add(F.make_date(year, F.lit(12), F.lit(31)), 1)
    eve = (F.dayofmonth(date) == 31) & (F.month(date) == 12) & (F.weekday(next_year) == 5)
    return reduce(lambda x, y: x + y, own, before) + eve.cast("int")


def listed_holidays_through(date: Column, holidays: Iterable[dt.date]) -> Column:
    """Listed weekdays up to and including ``date``: its place in the sorted list.

    The list is cut by year, so only the dates of one year are compared.
    """
    days = sorted({day for day in holidays if day.isoweekday() <= 5})
    if not days:
        return F.lit(0)
    first, last = days[0].year, days[-1].year
    by_year = [[day for day in days if day.year == year] for year in range(first, last + 1)]
    before, entries = 0, []
    for own in by_year:
        dates = ", ".join(f"DATE '{day.isoformat()}'" for day in own)
        entries.append(f"named_struct('before', {before}, 'days', cast(array({dates}) AS array<date>))")
        before += len(own)
    entry = F.get(F.expr(f"array({', '.join(entries)})"), F.year(date) - first)
    inside = entry["before"] + F.size(F.filter(entry["days"], lambda day: day <= date))
    return F.when(F.year(date) < first, 0).when(F.year(date) > last, before).otherwise(inside)


def business_days_through(date: Column, holidays: Iterable[dt.date] | None = None) -> Column:
    """Business days up to and including ``date``, from a fixed start."""
    if holidays is None:
        return weekdays_through(date) - federal_holidays_through(date)
    return weekdays_through(date) - listed_holidays_through(date, holidays)


def with_business_days(
    df: DataFrame,
    holidays: Iterable[dt.date] | None = None,
    start: str = "order_date",
    end: str = "ship_date",
    name: str = "business_days_to_ship",
) -> DataFrame:
    """Count business days after ``start`` up to and including ``end``.

    Holidays are the observed federal ones of any year unless they are listed. An end
    before the start has no defined count here and gives null, as does a missing date.
    """
    holidays = None if holidays is None else list(holidays)
    first, last = (business_days_through(F.col(date), holidays) for date in (start, end))
    count = F.when(F.col(end) >= F.col(start), (last - first).cast("int"))
    return df.withColumn(name, count).select(*df.columns, name)


def business_calendar(
    spark: SparkSession, first: dt.date, last: dt.date, holidays: Iterable[dt.date]
) -> DataFrame:
    """(date, business_index): business days passed up to and including each day."""
    days = (last - first).days + 1
    if days < 1:
        raise ValueError(f"calendar from {first} to {last}")
    date = F.date_add(F.lit(first), F.col("id").cast("int"))
    open_day = ~is_weekend(F.col("date"))
    closed = ", ".join(f"DATE '{day.isoformat()}'" for day in holidays)
    if closed:
        open_day = open_day & F.expr(f"date NOT IN ({closed})")
    # One row per day between the dates: the running sum needs no exchange.
    running = W.orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        spark.range(0, days, 1, 1)
        .withColumn("date", date)
        .select("date", F.sum(open_day.cast("int")).over(running).cast("int").alias("business_index"))
    )


def date_bounds(df: DataFrame, *dates: str) -> DataFrame:
    """One row with the first and last date over several columns."""
    columns = [F.col(c) for c in dates]
    low = F.least(*columns) if len(columns) > 1 else columns[0]
    high = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return df.agg(F.min(low).alias("first_date"), F.max(high).alias("last_date"))


def date_key(date: str | Column) -> Column:
    """Integer yyyyMMdd."""
    date = F.col(date) if isinstance(date, str) else date
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("int")


def date_dimension(bounds: DataFrame) -> DataFrame:
    """One row per day without gaps between the bounds."""
    days = bounds.select(F.explode(F.sequence("first_date", "last_date")).alias("date"))
    date = F.col("date")
    return days.select(
        date_key(date).alias("date_key"),
        date,
        F.year(date).alias("year"),
        F.quarter(date).alias("quarter"),
        F.month(date).alias("month"),
        F.date_format(date, "MMMM").alias("month_name"),
        F.date_format(date, "EEEE").alias("day_of_week"),
        is_weekend(date).alias("is_weekend"),
    )
