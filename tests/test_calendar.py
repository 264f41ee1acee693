import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harborline import config
from harborline.functions.calendar import (
    business_calendar,
    date_bounds,
    date_dimension,
    with_business_days,
)

D = dt.date


def count(spark, order, ship, holidays=()):
    df = spark.createDataFrame([(order, ship)], "order_date date, ship_date date")
    return with_business_days(df, holidays).first().business_days_to_ship


@pytest.mark.parametrize(
    "order, ship, holidays, days",
    [
        (D(2024, 1, 5), D(2024, 1, 8), [], 1),
        (D(2024, 1, 8), D(2024, 1, 9), [], 1),
        (D(2024, 1, 8), D(2024, 1, 8), [], 0),
        (D(2024, 7, 3), D(2024, 7, 5), [D(2024, 7, 4)], 1),
        (D(2015, 7, 2), D(2015, 7, 6), config.HOLIDAYS, 1),
        (D(2024, 1, 6), D(2024, 1, 7), [], 0),
        (D(2024, 1, 5), D(2024, 1, 6), [], 0),
    ],
)
def test_business_days(spark, order, ship, holidays, days):
    assert count(spark, order, ship, holidays) == days


def test_default_holidays_are_the_observed_federal_ones():
    assert len(config.HOLIDAYS) == 41
    for day in (D(2015, 7, 3), D(2016, 12, 26), D(2017, 1, 2), D(2017, 11, 10), D(2018, 1, 1)):
        assert day in config.HOLIDAYS
    assert all(day.isoweekday() <= 5 for day in config.HOLIDAYS)


def test_new_year_on_saturday_is_observed_the_year_before():
    assert D(1999, 12, 31) in config.federal_holidays(D(1999, 1, 1), D(1999, 12, 31))
    assert len(config.federal_holidays(D(1995, 1, 1), D(2002, 12, 31))) == 80


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1460), st.integers(0, 400)), min_size=20, max_size=60))
def test_business_days_agree_with_numpy(spark, offsets):
    start = D(2014, 1, 1)
    pairs = [
        (start + dt.timedelta(days=a), min(start + dt.timedelta(days=a + b), D(2018, 1, 5)))
        for a, b in offsets
    ]
    df = spark.createDataFrame(pairs, "order_date date, ship_date date")
    for row in with_business_days(df, config.HOLIDAYS).collect():
        day = dt.timedelta(days=1)
        expected = np.busday_count(
            row.order_date + day, row.ship_date + day, holidays=config.HOLIDAYS
        )
        assert row.business_days_to_ship == expected


def test_ship_before_order_has_no_count(spark):
    assert count(spark, D(2024, 1, 9), D(2024, 1, 5)) is None


def test_federal_holidays_of_any_year(spark):
    """Without a list, holidays follow from the dates, whatever years these are in."""
    years = [1583, 1899, 1970, 1999, 2000, 2020, 2021, 2022, 2027, 2100, 2399, 9000]
    pairs = []
    for year in years:
        ends = [D(year, 1, 1), D(year, 12, 31)]
        ends += [D(year, month, day) for month in range(1, 13) for day in (1, 4, 11, 18, 19, 25, 28)]
        pairs += [(D(year - 1, 12, 30), end) for end in ends]
        pairs += [(end, D(year + 1, 1, 2)) for end in ends]
    df = spark.createDataFrame(pairs, "order_date date, ship_date date")
    day = dt.timedelta(days=1)
    for row in with_business_days(df).collect():
        closed = config.federal_holidays(row.order_date, row.ship_date)
        expected = np.busday_count(row.order_date + day, row.ship_date + day, holidays=closed)
        assert row.business_days_to_ship == expected, row


def test_holidays_of_distant_years_weekends_and_repeats(spark):
    days = [D(2020, 1, 1), D(2024, 7, 6), D(2024, 7, 4), D(2024, 7, 4), D(1950, 5, 1)]
    assert count(spark, D(2024, 7, 3), D(2024, 7, 8), days) == 2
    assert count(spark, D(1949, 12, 30), D(1950, 5, 2), days) == np.busday_count(D(1949, 12, 31), D(1950, 5, 3)) - 1
    assert count(spark, D(2030, 1, 1), D(2030, 1, 2), days) == 1


def test_a_sentinel_date_stops_no_other_row(spark):
    rows = [(D(2024, 1, 5), D(2024, 1, 8)), (D(2024, 1, 5), D(9999, 12, 31)), (D(1, 1, 1), D(1, 1, 2)), (None, D(2024, 1, 8))]
    df = spark.createDataFrame(rows, "order_date date, ship_date date")
    for holidays in (None, config.HOLIDAYS):
        found = [r.business_days_to_ship for r in with_business_days(df, holidays).collect()]
        assert found[0] == 1 and found[1] > 1_900_000 and found[2] == 1 and found[3] is None


def test_counting_runs_no_job_and_joins_nothing(spark):
    df = spark.createDataFrame([(D(2024, 1, 5), D(2024, 1, 8))], "order_date date, ship_date date")
    plan = with_business_days(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_calendar_table_agrees_with_the_closed_form(spark):
    first, last = D(2015, 12, 20), D(2023, 1, 5)
    calendar = business_calendar(spark, first, last, config.federal_holidays(first, last))
    dated = calendar.selectExpr("date", "business_index", "DATE '2015-12-19' AS order_date", "date AS ship_date")
    assert with_business_days(dated).where("business_index <> business_days_to_ship").count() == 0
    with pytest.raises(ValueError, match="calendar from"):
        business_calendar(spark, last, first, [])


def test_date_dimension(spark):
    df = spark.createDataFrame(
        [(D(2017, 12, 30), D(2018, 1, 1)), (D(2017, 12, 29), D(2017, 12, 31))],
        "order_date date, ship_date date",
    )
    rows = date_dimension(date_bounds(df, "order_date", "ship_date")).orderBy("date").collect()
    assert [r.date_key for r in rows] == [20171229, 20171230, 20171231, 20180101]
    assert [r.is_weekend for r in rows] == [False, True, True, False]
    assert tuple(rows[0]) == (20171229, D(2017, 12, 29), 2017, 4, 12, "December", "Friday", False)


def test_date_dimension_spans_any_dates(spark):
    df = spark.createDataFrame([(D(1500, 1, 1), D(9999, 12, 31))], "first_date date, last_date date")
    assert date_dimension(df).count() == (D(9999, 12, 31) - D(1500, 1, 1)).days + 1
