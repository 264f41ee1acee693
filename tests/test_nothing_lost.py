"""Lines, orders and groups that must not vanish or change class silently."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from harborline import config, schema
from harborline.functions.calendar import business_calendar, with_business_days
from harborline.operators import diagnostics, facts, scenarios, star, summaries
from harborline.plans import sql_path
from harborline.sources.order_tables import TABLES, OrderTables

STAMP = dt.datetime


@pytest.fixture()
def folder(spark, tmp_path):
    """Order tables with an orphan line, missing dates, late years and odd priorities."""
    day = STAMP(2015, 7, 2)
    orders = [(1, 1, day, "1-URGENT"), (2, 1, None, "2-HIGH"), (3, 1, day, "5-LOW"), (4, 1, day, "9-BOGUS"),
              (5, 1, day, None)]
    lines = [(1, day + dt.timedelta(4)), (1, day - dt.timedelta(1)), (2, day), (3, None), (99, day),
             (4, day), (5, day)]
    items = [(k, 1, 1, n, 1.0, 10.0, 0.0, date) for n, (k, date) in enumerate(lines)]
    for name, rows in {"orders": orders, "lineitem": items}.items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_line_accounting_adds_up(spark, folder):
    found = {r.outcome: r.line_count for r in OrderTables(spark, folder).line_accounting().collect()}
    assert found.pop("all lines") == sum(found.values()) == 7
    assert found == {"order missing": 1, "order date missing": 1, "ship date missing": 1,
                     "shipped before order": 1, "accepted": 3}


def test_calendar_follows_the_dates(spark, folder):
    tables = OrderTables(spark, folder)
    assert tables.bounds() == (dt.date(2015, 7, 1), dt.date(2015, 7, 6))
    row = tables.counted(tables.orders().where("order_id = 1")).first()
    assert row.business_days_to_ship == 1  # the 3rd is a holiday, then a weekend


def test_unknown_priorities_fail_the_classification(spark, folder):
    tables = OrderTables(spark, folder)
    orders = tables.counted(tables.orders())
    modes = {r.order_id: r.ship_mode for r in orders.collect()}
    assert modes == {1: "Same Day", 4: None, 5: None}
    with pytest.raises(Exception, match="Unknown ship modes"):
        scenarios.classify(orders, tables.scenarios()).collect()


def test_unlisted_groups_come_last(spark):
    rows = spark.createDataFrame([("B", 1), ("X", 2), (None, 3), ("A", 4)], "region string, n int")
    found = [r.region for r in diagnostics.ranked(rows, "region", ["A", "B"]).collect()]
    assert found == ["A", "B", "X", None]
    with pytest.raises(Exception, match="No rows for region: C"):
        diagnostics.ranked(rows, "region", ["A", "C"]).select("n").count()


def test_orders_without_business_days_are_neither_late_nor_on_time(spark):
    """All four paths agree on an order that ships before its order date."""
    day = dt.date(2015, 1, 5)
    lines = spark.createDataFrame(
        [(1, day, day, "Same Day", "A", Decimal(1), Decimal(1)),
         (2, day, day - dt.timedelta(1), "Same Day", "A", Decimal(1), Decimal(1))],
        "order_id bigint, order_date date, ship_date date, ship_mode string, region string, "
        "sales decimal(18,4), profit decimal(18,4)",
    )
    table = scenarios.scenario_table(spark)
    calendar = business_calendar(spark, day - dt.timedelta(1), day, [])
    heads = facts.collapse(lines, sql_path.COLUMNS[1:5])
    counted = with_business_days(heads)
    orders = scenarios.attach_financials(counted, facts.order_financials(lines))
    monthly = orders.withColumn("order_month", F.trunc("order_date", "month"))
    paths = [
        summaries.summarize(scenarios.expand(orders, table)),
        summaries.summarize_orders(orders, table),
        summaries.summarize_families(monthly, table).where("family = 'overall'"),
        sql_path.summaries(lines, table, calendar, ["overall"])["overall"],
    ]
    for found in paths:
        for row in found.collect():
            assert (row.orders, row.successful_orders, row.late_orders) == (2, 1, 0)


def test_holidays_follow_the_dates(spark):
    assert config.federal_holidays(dt.date(2014, 1, 1), dt.date(2018, 1, 1)) == config.HOLIDAYS
    assert dt.date(2021, 6, 18) in config.federal_holidays(dt.date(2021, 1, 1), dt.date(2021, 12, 31))
    rows = [(dt.date(2021, 7, 2), dt.date(2021, 7, 6))]
    lines = spark.createDataFrame(rows, "order_date date, ship_date date")
    assert with_business_days(lines).first().business_days_to_ship == 1


def test_guards_stay_when_their_columns_are_not_read(spark):
    """A count reads no column, and fails all the same."""
    day = dt.date(2015, 1, 5)
    rows = spark.createDataFrame([("A", day, day + dt.timedelta(9), "Drone", 1)],
                                 "order_id string, order_date date, ship_date date, ship_mode string, "
                                 "business_days_to_ship int")
    table = scenarios.scenario_table(spark)
    totals = spark.createDataFrame([], "order_id string, order_sales int, order_profit int")
    keys = [F.lit(None).cast("int").alias(c) for c in schema.STAR_KEYS]
    measures = [F.lit(1).alias(c) for c in ("sales", "quantity", "discount", "profit")]
    fact = rows.select(F.lit("r1").alias("row_id"), "order_id", *keys, *measures)
    for found, message in (
        (scenarios.classify(rows, table), "Unknown ship modes: Drone"),
        (scenarios.with_threshold(rows, scenarios.days_of(table, "base")), "Unknown ship modes: Drone"),
        (scenarios.attach_financials(rows, totals), "No order lines for order A"),
        (star.fact_columns(fact), "No dimension row for order_date_key, ship_date_key"),
    ):
        with pytest.raises(Exception, match=message):
            found.count()
