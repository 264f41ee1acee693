"""Volumes, trends, hotspots, rankings and correlations of one scenario.

Inputs named ``orders`` hold one row per order with ``is_late``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import config
from harborline.functions.columns import correlation, rate, required
from harborline.sources.inline import inline_table

HOTSPOT = ["sub_category", "ship_mode", "region"]


def volume_and_rate(rows: DataFrame, *dims: str | Column) -> DataFrame:
    """Orders, late orders and late rate per group.

    Counts rows: the input holds an order at most once per group.
    """
    return (
        rows.groupBy(*dims)
        .agg(F.count(F.lit(1)).alias("orders"), F.count_if("is_late").alias("late_orders"))
        .withColumn("late_rate", rate("late_orders", "orders"))
    )


def overall_rate(orders: DataFrame) -> DataFrame:
    """Late share of all orders."""
    return orders.agg(F.avg(F.col("is_late").cast("int")).alias("late_rate"))


def ranked(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows in the given value order, then those of values not listed, nulls last; a
    listed value without a row fails the job. The guard is a filter, so no pruning of
    columns takes it away."""
    ranks = inline_table(df.sparkSession, "_rank, _value", list(enumerate(values)))
    rows = df.withColumn("_found", F.lit(True))
    found = rows.join(ranks, F.col(column).eqNullSafe(F.col("_value")), "full")
    message = F.concat(F.lit(f"No rows for {column}: "), F.col("_value"))
    checked = found.where(required(F.col("_found"), message))
    order = [F.col("_rank").asc_nulls_last(), F.col(column).asc_nulls_last()]
    return checked.orderBy(*order).select(*df.columns)


def region_volume(orders: DataFrame, regions: Sequence[str] = config.REGIONS) -> DataFrame:
    """Volume and late rate per region in report order."""
    return ranked(volume_and_rate(orders, "region"), "region", regions)


def mode_year_trend(orders: DataFrame) -> DataFrame:
    """Volume and late rate per ship mode and order year."""
    trend = volume_and_rate(orders, "ship_mode", F.year("order_date").alias("order_year"))
    return trend.orderBy("ship_mode", "order_year")


def year_rates(orders: DataFrame) -> DataFrame:
    return volume_and_rate(orders, F.year("order_date").alias("order_year")).orderBy("order_year")


def membership(
    lines: DataFrame, orders: DataFrame, column: str, attributes: Sequence[str] = ()
) -> DataFrame:
    """Distinct (order, value) pairs of the lines with order attributes.

    Pairs are reduced before the join, so an order counts once per value however
    many lines it has. An order may belong to several values.
    """
    pairs = lines.select("order_id", column).distinct()
    return pairs.join(orders.select("order_id", "is_late", *attributes), "order_id")


def member_rates(lines: DataFrame, orders: DataFrame, column: str, minimum: int = 0) -> DataFrame:
    """Rate per value of a line column among values with enough orders."""
    rates = volume_and_rate(membership(lines, orders, column), column)
    return rates.where(F.col("orders") >= minimum)


def group_rates(orders: DataFrame, column: str, minimum: int = 0) -> DataFrame:
    """Rate per value of an order column among values with enough orders."""
    return volume_and_rate(orders, column).where(F.col("orders") >= minimum)


def _top(df: DataFrame, n: int, measures: Sequence[str], ties: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(m).desc_nulls_last() for m in measures], *ties).limit(n)


def both_ends(rates: DataFrame, column: str, highest: int, lowest: int) -> DataFrame:
    """The highest and lowest rates, labelled; ties go by volume, then value."""
    high = _top(rates, highest, ["late_rate", "orders"], [column])
    low = rates.orderBy(
        F.col("late_rate").asc_nulls_last(), F.col("orders").desc_nulls_last(), column
    ).limit(lowest)
    return high.withColumn("end", F.lit("high")).unionByName(low.withColumn("end", F.lit("low")))


def top_months(orders: DataFrame, minimum: int = config.MIN_MONTH_ORDERS, n: int = 3) -> DataFrame:
    """Months with the highest late rate among those with enough orders."""
    month = F.date_format("order_date", "yyyy-MM").alias("order_month_label")
    rates = volume_and_rate(orders, month).where(F.col("orders") >= minimum)
    return _top(rates, n, ["late_rate", "orders"], ["order_month_label"])


def hotspots(
    lines: DataFrame,
    orders: DataFrame,
    minimum: int = config.MIN_CELL_ORDERS,
    by_rate: int = 9,
    by_count: int = 1,
) -> DataFrame:
    """Highest-rate cells plus the cells with most late orders."""
    members = membership(lines, orders, "sub_category", ["ship_mode", "region"])
    eligible = volume_and_rate(members, *HOTSPOT).where(F.col("orders") >= minimum)
    rated = _top(eligible, by_rate, ["late_rate", "orders"], HOTSPOT)
    counted = _top(eligible, by_count, ["late_orders", "orders"], HOTSPOT)
    both = rated.withColumn("is_leader", F.lit(False)).unionByName(
        counted.withColumn("is_leader", F.lit(True))
    )
    # A cell may be in both lists: one row remains, marked as leader if it leads.
    measures = ["orders", "late_orders", "late_rate"]
    return (
        both.groupBy(*HOTSPOT, *measures)
        .agg(F.max("is_leader").alias("is_leader"))
        .withColumn("label", F.concat_ws(" · ", *HOTSPOT))
        .orderBy(F.col("late_orders").desc(), F.col("orders").desc(), *HOTSPOT)
    )


def with_order_ratios(orders: DataFrame) -> DataFrame:
    """Sales-weighted discount and margin of each order; null without sales."""
    return orders.withColumns(
        {
            "weighted_discount": rate("order_discount_value", "order_sales"),
            "margin": rate("order_profit", "order_sales"),
        }
    )


def late_against_on_time(orders: DataFrame, *dims: str) -> DataFrame:
    """Mean discount, profit and margin of late and of on-time orders."""
    return (
        with_order_ratios(orders)
        .groupBy(*dims, "is_late")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.avg("weighted_discount").alias("avg_weighted_discount"),
            rate(F.sum("order_profit"), F.count("order_profit")).alias("avg_order_profit"),
            F.avg("margin").alias("avg_margin"),
        )
    )


def late_correlations(orders: DataFrame) -> DataFrame:
    """Correlation of the late flag with discount and with profit."""
    late = F.col("is_late").cast("double")
    one_row = with_order_ratios(orders).agg(
        correlation(late, F.col("weighted_discount")).alias("weighted_discount"),
        correlation(late, F.col("order_profit").cast("double")).alias("order_profit"),
    )
    pairs = [
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("correlation"))
        for c in one_row.columns
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def region_years(orders: DataFrame) -> DataFrame:
    return volume_and_rate(orders, "region", F.year("order_date").alias("order_year"))


def _volume_against_rate() -> Column:
    return correlation(F.col("orders").cast("double"), F.col("late_rate")).alias("correlation")


def region_year_correlation(orders: DataFrame) -> DataFrame:
    """Correlation of volume and late rate over all region-years."""
    groups = region_years(orders)
    return groups.agg(F.count(F.lit(1)).alias("observations"), _volume_against_rate())


def within_region_correlation(orders: DataFrame) -> DataFrame:
    """The same correlation over the years of each region."""
    groups = region_years(orders)
    return groups.groupBy("region").agg(
        F.count(F.lit(1)).alias("observations"), _volume_against_rate()
    )
