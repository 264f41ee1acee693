"""Source file to facts, star schema, scenarios and summaries."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline import config
from harborline.operators import facts, quality, scenarios, star, summaries
from harborline.session import materialise, size_for, temporary
from harborline.sources import files


def transform(
    spark: SparkSession,
    path: str,
    expected_rows: int | None = config.EXPECTED_ROWS,
    thresholds: config.Thresholds = config.THRESHOLDS,
    holidays: Iterable[dt.date] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(order lines, order fact) from a delimited source, after validation.

    The text is parsed once into the shared folder: validation and facts
    then read typed columns instead of parsing it again.
    """
    size_for(spark, path, spread=files.spread(spark, path))
    lines = materialise(files.read_source(spark, path), "source", files.PARQUET_CODEC)
    return lines, _validated_orders(lines, expected_rows, thresholds, holidays)


def _validated_orders(
    lines: DataFrame,
    expected_rows: int | None,
    thresholds: config.Thresholds,
    holidays: Iterable[dt.date] | None,
) -> DataFrame:
    """The order fact of stored lines that keep the contract."""
    table = scenarios.scenario_table(lines.sparkSession, thresholds)
    quality.validate(lines, scenarios.days_of(table, "base"), expected_rows)
    # Consistency per order has just been validated.
    return facts.build_orders(lines, table, holidays, check=False)


def order_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The order fact with its totals, checked to join one to one."""
    quality.require_unique(orders, ["order_id"], "Order fact")
    return scenarios.attach_financials(orders, facts.order_financials(lines))


# Report families; months are keyed by text.
FAMILIES = {**summaries.FAMILIES, "by_month": ["order_month_label"]}


def _with_month(totals: DataFrame) -> DataFrame:
    return totals.withColumn("order_month_label", F.date_format("order_date", "yyyy-MM"))


def analyze(
    orders: DataFrame, lines: DataFrame, thresholds: config.Thresholds = config.THRESHOLDS
) -> dict[str, DataFrame]:
    """Scenario detail and the four summaries."""
    totals = order_totals(orders, lines)
    table = scenarios.scenario_table(totals.sparkSession, thresholds)
    monthly = _with_month(totals)
    return {
        "scenario_orders": scenarios.expand(totals, table),
        **{n: summaries.summarize_orders(monthly, table, dims) for n, dims in FAMILIES.items()},
    }


def run(
    spark: SparkSession,
    path: str,
    output: str,
    expected_rows: int | None = config.EXPECTED_ROWS,
    thresholds: config.Thresholds = config.THRESHOLDS,
    holidays: Iterable[dt.date] | None = None,
    delimited: bool = False,
) -> dict[str, DataFrame]:
    """Write every table under a folder of this run in ``output``, publish them as a
    whole and return them; ``files.published`` reads the current set.

    Each stage reads what the stage before it wrote, so nothing is computed twice and a
    lost executor costs at most one stage. A run that fails at any stage, or whose source
    breaks the contract, leaves the set published before it as it was and nothing of its
    own. ``delimited`` also exports every table as text under ``csv`` of the run.
    """
    name_of_run = f"run-{uuid.uuid4().hex}"
    folder = f"{output}/{name_of_run}"
    size_for(spark, path, spread=files.spread(spark, path))
    try:
        with temporary(spark):
            written = _written(spark, path, folder, expected_rows, thresholds, holidays, delimited)
        files.publish(spark, output, name_of_run, {name: table.schema for name, table in written.items()})
    except BaseException:
        files.remove(spark, folder)
        raise
    return written


def _written(
    spark: SparkSession,
    path: str,
    folder: str,
    expected_rows: int | None,
    thresholds: config.Thresholds,
    holidays: Iterable[dt.date] | None,
    delimited: bool,
) -> dict[str, DataFrame]:
    def store(name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        files.write_table(df, f"{folder}/{name}", partition_by)
        stored = files.read_table(spark, f"{folder}/{name}", df.schema)
        return stored.select(*df.columns)

    lines = store("fact_order_lines", files.read_source(spark, path))
    orders = _validated_orders(lines, expected_rows, thresholds, holidays)
    written = {"fact_order_lines": lines, "fact_orders": store("fact_orders", orders)}
    for name, table in star.build(lines, store).items():
        written[name] = table
    table = scenarios.scenario_table(spark, thresholds)
    totals = materialise(order_totals(written["fact_orders"], lines), "order-totals", files.PARQUET_CODEC)
    detail = scenarios.expand(totals, table)
    written["scenario_orders"] = store("scenario_orders", detail, ("scenario",))
    # Orders are read once for all summaries; the cells are few.
    dims = [d for family in FAMILIES.values() for d in family]
    folded = materialise(summaries.cells(_with_month(totals), dims), "cells")
    for name, family in FAMILIES.items():
        written[name] = store(name, summaries.summarize_cells(folded, table, family))
    if delimited:
        for name, stored in written.items():
            files.write_delimited(stored, f"{folder}/csv/{name}")
    return written
