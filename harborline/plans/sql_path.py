"""The four summaries stated in SQL, as a second path to compare against.

It starts from order lines and shares no step with the DataFrame calls: lines are summed
and their headers taken here, and business days come from a calendar table instead of a
closed form.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from harborline.session import materialise

# Line columns in use.
COLUMNS = ["order_id", "order_date", "ship_date", "ship_mode", "region", "sales", "profit"]

# One pass over the lines: an order whose lines disagree on a header field forms several
# groups, and their number shows it.
CELLS = """
    WITH orders AS (
        SELECT order_id, order_date, ship_date, ship_mode, region,
               sum(sales) AS order_sales, sum(profit) AS order_profit
        FROM {lines} GROUP BY order_id, order_date, ship_date, ship_mode, region
    ),
    dated AS (
        SELECT o.*, CASE WHEN o.ship_date >= o.order_date
                         THEN shipped.business_index - ordered.business_index END AS business_days
        FROM orders AS o
        LEFT JOIN {calendar} AS ordered ON ordered.date = o.order_date
        LEFT JOIN {calendar} AS shipped ON shipped.date = o.ship_date
    )
    SELECT s.scenario, o.ship_mode, o.region, date_format(o.order_date, 'yyyy-MM') AS order_month,
           o.business_days > s.scenario_sla_days AS is_late,
           count(*) AS n, sum(o.order_sales) AS sales, sum(o.order_profit) AS profit
    FROM dated AS o JOIN {scenario_sla} AS s ON s.ship_mode = o.ship_mode
    GROUP BY ALL
"""

DIMENSIONS = {
    "overall": "",
    "by_ship_mode": ", ship_mode",
    "by_region": ", region",
    "by_month": ", order_month",
}


def _summary(dims: str) -> str:
    def held(value: str, flag: str = "") -> str:
        return f"coalesce(sum({value}){f' FILTER (WHERE {flag})' if flag else ''}, 0)"

    def money(value: str, flag: str = "") -> str:
        return f"CAST({held(value, flag)} AS DECIMAL(38, 4))"

    return f"""
        SELECT *, successful_orders / orders AS success_rate, late_orders / orders AS late_order_rate
        FROM (
            SELECT scenario{dims}, {held('n')} AS orders,
                {held('n', 'NOT is_late')} AS successful_orders, {held('n', 'is_late')} AS late_orders,
                {money('sales')} AS total_sales, {money('sales', 'is_late')} AS late_order_sales,
                {money('profit')} AS total_profit, {money('profit', 'is_late')} AS late_order_profit
            FROM {{cells}} GROUP BY scenario{dims}
        )"""


def summaries(
    lines: DataFrame,
    table: DataFrame,
    calendar: DataFrame,
    names: Iterable[str] = tuple(DIMENSIONS),
) -> dict[str, DataFrame]:
    """Summary tables by name, from lines with ``COLUMNS``; months are keyed by text.

    The lines are read once: the cells of all scenarios are few, and they are stored.
    """
    spark = lines.sparkSession
    folded = spark.sql(CELLS, lines=lines.select(*COLUMNS), calendar=calendar, scenario_sla=table)
    cells = materialise(folded, "sql-cells")
    return {name: spark.sql(_summary(DIMENSIONS[name]), cells=cells) for name in names}
