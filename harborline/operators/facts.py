"""Order financials and the collapse of lines to one row per order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import schema
from harborline.functions.calendar import with_business_days
from harborline.functions.columns import days_between
from harborline.operators import quality, scenarios


def _money() -> list[Column]:
    return [
        F.sum("sales").cast(schema.ORDER_TOTAL).alias("order_sales"),
        F.sum("profit").cast(schema.ORDER_TOTAL).alias("order_profit"),
        F.count(F.lit(1)).alias("order_line_count"),
    ]


def order_financials(lines: DataFrame) -> DataFrame:
    """Sales, profit and line count per order."""
    return lines.groupBy("order_id").agg(*_money())


def collapse(
    lines: DataFrame, fields: Sequence[str] = schema.ORDER_FIELDS, check: bool = True
) -> DataFrame:
    """One row per order from fields that are constant on its lines.

    The fields are grouping keys, so the aggregation stays hash-based although
    most of them are text.
    """
    if check:
        quality.require_consistent(lines, ["order_id"], fields)
    return lines.select("order_id", *fields).distinct()


def order_facts(lines: DataFrame, fields: Sequence[str], ship: str = "ship_date") -> DataFrame:
    """Order attributes and financials in one aggregation.

    ``ship`` may vary on the lines of an order; the order ships with its last
    line. All other fields must be constant.
    """
    return lines.groupBy("order_id", *fields).agg(
        F.max(ship).alias("ship_date"),
        *_money(),
        F.sum(F.col("sales") * F.col("discount")).alias("order_discount_value"),
    )


def with_sla(
    orders: DataFrame, table: DataFrame, holidays: Iterable[dt.date] | None = None
) -> DataFrame:
    """Add calendar days, business days, allowed days, variance and late flag."""
    counted = with_business_days(
        orders.withColumn("calendar_days_to_ship", days_between("order_date", "ship_date")),
        holidays,
    )
    return scenarios.with_threshold(counted, scenarios.days_of(table, "base"))


def build_orders(
    lines: DataFrame,
    table: DataFrame,
    holidays: Iterable[dt.date] | None = None,
    check: bool = True,
) -> DataFrame:
    """The order fact: order-level fields plus the five derived ones."""
    orders = collapse(lines, check=check)
    return with_sla(orders, table, holidays).select(*schema.FACT_ORDERS)
