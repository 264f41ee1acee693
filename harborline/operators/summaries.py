"""Scenario summaries by any dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import config, schema
from harborline.functions.columns import rate
from harborline.operators import quality, scenarios

# The four report families and their dimensions.
FAMILIES = {
    "overall": [],
    "by_ship_mode": ["ship_mode"],
    "by_region": ["region"],
    "by_month": ["order_month"],
}


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "success_rate": rate("successful_orders", "orders"),
            "late_order_rate": rate("late_orders", "orders"),
        }
    )


def _total(measure: str | Column) -> Column:
    return F.coalesce(F.sum(measure), F.lit(0)).cast(schema.GRAND_TOTAL)


def in_report_order(df: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Sort by scenario rank, then dimensions with nulls last."""
    names = F.array(*[F.lit(s) for s in config.SCENARIOS])
    rank = F.nullif(F.array_position(names, F.col("scenario")), F.lit(0))
    return df.orderBy(rank.asc_nulls_last(), *[F.col(d).asc_nulls_last() for d in dims])


def summarize(scenario_orders: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Summary of any (scenario, order) table, counting distinct orders."""
    totals = scenario_orders.groupBy("scenario", *dims).agg(
        F.count_distinct("order_id").alias("orders"),
        F.count_if("is_success").alias("successful_orders"),
        F.count_if("is_late").alias("late_orders"),
        _total("order_sales").alias("total_sales"),
        _total("late_order_sales").alias("late_order_sales"),
        _total("order_profit").alias("total_profit"),
        _total("late_order_profit").alias("late_order_profit"),
    )
    return in_report_order(_rates(totals), dims)


def cells(orders: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Orders and totals per ship mode, business days and dimensions.

    Lateness depends on ship mode and business days alone, so these cells hold
    all that any scenario needs. Their number is set by the domains, not by the
    number of orders.
    """
    keys = list(dict.fromkeys([*dims, "ship_mode", "business_days_to_ship"]))
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_sales").alias("order_sales"),
        F.sum("order_profit").alias("order_profit"),
    )


def _cell_measures() -> list[Column]:
    # Without business days an order is neither late nor on time, on every path.
    late = F.col("is_late")
    return [
        F.sum("orders").alias("orders"),
        F.sum(F.when(~late, F.col("orders")).otherwise(0)).alias("successful_orders"),
        F.sum(F.when(late, F.col("orders")).otherwise(0)).alias("late_orders"),
        _total("order_sales").alias("total_sales"),
        _total(F.when(late, F.col("order_sales"))).alias("late_order_sales"),
        _total("order_profit").alias("total_profit"),
        _total(F.when(late, F.col("order_profit"))).alias("late_order_profit"),
    ]


def summarize_cells(
    folded: DataFrame, table: DataFrame, dims: Sequence[str] = ()
) -> DataFrame:
    """Summary from cells that hold at least the given dimensions."""
    flagged = scenarios.classify(folded, table)
    totals = flagged.groupBy("scenario", *dims).agg(*_cell_measures())
    return in_report_order(_rates(totals), dims)


def summarize_orders(orders: DataFrame, table: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """The same summary from one row per order, expanding scenarios last.

    Orders are folded into cells before the scenario join, so the fan-out
    applies to the cells and no (scenario, order) row is ever shuffled.
    """
    return summarize_cells(cells(orders, dims), table, dims)


def summarize_distinct(orders: DataFrame, table: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Summary of distinct orders from a table that should hold each order once.

    That it does is checked on order_id alone, so counting rows counts distinct orders:
    the scenarios then meet cells, and no (scenario, order) row crosses an exchange.
    """
    return summarize_orders(quality.require_unique(orders, ["order_id"], "Orders"), table, dims)


def summarize_families(
    orders: DataFrame, table: DataFrame, families: dict[str, list[str]] = FAMILIES
) -> DataFrame:
    """All families in one pass through grouping sets over the cells."""
    dims = list(dict.fromkeys(d for family in families.values() for d in family))
    flagged = scenarios.classify(cells(orders, dims), table)
    sets = [[F.col(c) for c in ("scenario", *family)] for family in families.values()]
    grouped = flagged.groupingSets(sets, F.col("scenario"), *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("_set"), *_cell_measures()
    )
    # Bit i of grouping_id, counted from the last grouping column, marks it absent.
    label = F.lit(None).cast("string")
    for name, family in families.items():
        absent = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in family)
        label = F.when(F.col("_set") == absent, F.lit(name)).otherwise(label)
    return _rates(grouped.withColumn("family", label)).select(
        "family", "scenario", *dims, *schema.SUMMARY_MEASURES
    )
