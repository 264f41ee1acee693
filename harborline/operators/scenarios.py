"""Threshold scenarios held as data, and classification against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline import config
from harborline.functions.columns import (
    guarded,
    is_late,
    month_label,
    month_start,
    where_late,
)
from harborline.sources.inline import inline_table


def scenario_table(
    spark: SparkSession, thresholds: config.Thresholds = config.THRESHOLDS
) -> DataFrame:
    """(scenario_rank, scenario, ship_mode, scenario_sla_days), one row per pair."""
    columns = "scenario_rank, scenario, ship_mode, scenario_sla_days"
    return inline_table(spark, columns, thresholds.rows())


def days_of(table: DataFrame, scenario: str) -> DataFrame:
    """(ship_mode, sla_days) of one scenario."""
    return table.where(F.col("scenario") == scenario).select(
        "ship_mode", F.col("scenario_sla_days").alias("sla_days")
    )


def _known(df: DataFrame, days: str) -> DataFrame:
    mode = F.coalesce(F.col("ship_mode"), F.lit("null"))
    return guarded(df, F.col(days).isNotNull(), F.concat(F.lit("Unknown ship modes: "), mode))


def with_threshold(df: DataFrame, days: DataFrame) -> DataFrame:
    """Add allowed days, variance and late flag; an unknown mode fails the job."""
    return (
        _known(df.join(F.broadcast(days), "ship_mode", "left"), "sla_days")
        .withColumn("sla_variance", F.col("business_days_to_ship") - F.col("sla_days"))
        .withColumn("is_late", is_late("business_days_to_ship", "sla_days"))
        .select(*df.columns, "sla_days", "sla_variance", "is_late")
    )


def classify(df: DataFrame, table: DataFrame) -> DataFrame:
    """Repeat each row per scenario with its limit, late and success flag.

    The table holds a handful of rows, so it is broadcast: the fan-out never
    crosses an exchange. An unknown ship mode fails the job.
    """
    kept = [c for c in df.columns if c not in ("is_late", "is_success")]
    joined = df.select(*kept).join(F.broadcast(table), "ship_mode", "left")
    return (
        _known(joined, "scenario_sla_days")
        .withColumn("is_late", is_late("business_days_to_ship", "scenario_sla_days"))
        .withColumn("is_success", ~F.col("is_late"))
        .select(
            "scenario_rank", "scenario", *kept, "scenario_sla_days", "is_late", "is_success"
        )
    )


def attach_financials(orders: DataFrame, financials: DataFrame) -> DataFrame:
    """Join order totals one to one; an order without lines fails the job."""
    message = F.concat(F.lit("No order lines for order "), F.col("order_id").cast("string"))
    found = F.col("order_sales").isNotNull() & F.col("order_profit").isNotNull()
    return guarded(orders.join(financials, "order_id", "left"), found, message)


def expand(orders: DataFrame, table: DataFrame) -> DataFrame:
    """One row per order and scenario, from orders that carry their totals.

    The base threshold and variance stay under their own names in every
    scenario; only ``scenario_sla_days`` follows the scenario.
    """
    named = orders.withColumnsRenamed(
        {"sla_days": "base_sla_days", "sla_variance": "base_sla_variance"}
    )
    return (
        classify(named, table)
        .withColumn("late_order_sales", where_late("order_sales"))
        .withColumn("late_order_profit", where_late("order_profit"))
        .select("*", month_start("order_date"), month_label("order_date"))
        .drop("scenario_rank")
    )
