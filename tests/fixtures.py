"""Hand-made inputs."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from harborline import schema

D = dt.date

LINE = {
    "row_id": "1",
    "order_id": "A",
    "order_date": D(2017, 1, 3),
    "ship_date": D(2017, 1, 5),
    "ship_mode": "Second Class",
    "customer_id": "C1",
    "customer_name": "Ann",
    "segment": "Consumer",
    "country": "United States",
    "city": "Salem",
    "state": "Oregon",
    "postal_code": "01234",
    "region": "West",
    "product_id": "P1",
    "category": "Technology",
    "sub_category": "Phones",
    "product_name": "Product One",
    "sales": Decimal("10.0"),
    "quantity": 1,
    "discount": Decimal("0.0"),
    "profit": Decimal("2.0"),
}


def lines(spark: SparkSession, *changes: dict) -> DataFrame:
    """One line per dict of changes to the standard line, with fresh row ids."""
    rows = [
        {**LINE, "row_id": str(i), **change} for i, change in enumerate(changes or [{}], start=1)
    ]
    return spark.createDataFrame([[r[c] for c in schema.LINE_COLUMNS] for r in rows], schema.LINES)


ORDERS = "order_id string, order_date date, ship_mode string, region string, " \
    "business_days_to_ship int, sla_days int, sla_variance int, is_late boolean"


def small_orders(spark: SparkSession, *extra: tuple) -> DataFrame:
    rows = [
        ("A", D(2017, 1, 2), "Standard Class", "West", 5, 5, 0, False),
        ("B", D(2017, 2, 3), "First Class", "East", 2, 1, 1, True),
        ("C", D(2017, 2, 4), "Same Day", "West", 0, 0, 0, False),
        *extra,
    ]
    return spark.createDataFrame(rows, ORDERS)


def small_lines(spark: SparkSession, *extra: tuple) -> DataFrame:
    rows = [
        ("1", "A", Decimal(10), Decimal(1)),
        ("2", "A", Decimal(5), Decimal(2)),
        ("3", "B", Decimal(20), Decimal(-3)),
        ("4", "C", Decimal(7), Decimal(1)),
        *extra,
    ]
    kinds = "row_id string, order_id string, sales decimal(18,4), profit decimal(18,4)"
    return spark.createDataFrame(rows, kinds)
