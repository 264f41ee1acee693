"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_between(start: str, end: str) -> Column:
    """Calendar days from ``start`` to ``end``."""
    return F.datediff(F.col(end), F.col(start))


def month_start(date: str) -> Column:
    return F.trunc(F.col(date), "month").alias("order_month")


def month_label(date: str) -> Column:
    return F.date_format(F.col(date), "yyyy-MM").alias("order_month_label")


def rate(part: str | Column, whole: str | Column) -> Column:
    """Unrounded double ratio; null where the denominator is zero."""
    return F.try_divide(_double(part), _double(whole))


def is_late(days: str, limit: str) -> Column:
    """Late means more business days than allowed; equality is on time."""
    return F.col(days) > F.col(limit)


def where_late(measure: str, late: str = "is_late") -> Column:
    """The measure on late rows, zero elsewhere."""
    return F.when(F.col(late), F.col(measure)).otherwise(0)


def required(column: Column, message: Column) -> Column:
    """The column, or a failed job where it is null."""
    return F.coalesce(column, F.raise_error(message))


def guarded(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """The rows of ``df``; one for which ``holds`` is not true fails the job.

    The guard is a filter, so it stays whatever columns are read. Behind an outer join
    the message has to name a column of the other side: the optimiser tries filters of
    one side alone on a row of nulls, which would fail at once.
    """
    return df.where(F.when(holds, True).otherwise(F.raise_error(message).cast("boolean")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; null where either side has no variance.

    ``corr`` divides by zero under ANSI for a constant column.
    """
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _double(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("double")
