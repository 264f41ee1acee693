import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from harborline.operators import diagnostics

D = dt.date
KINDS = (
    "order_id string, ship_mode string, region string, order_date date, is_late boolean, "
    "order_sales decimal(28,4), order_profit decimal(28,4), order_discount_value decimal(38,10)"
)


def orders(spark, *rows):
    """(id, mode, region, date, late, sales, profit, discount value)"""
    return spark.createDataFrame(
        [(*r[:5], *(Decimal(str(v)) for v in r[5:])) for r in rows], KINDS
    )


@pytest.fixture(scope="module")
def sample(spark):
    return orders(
        spark,
        ("A", "Same Day", "West", D(2016, 1, 5), True, 100, 10, 20),
        ("B", "Same Day", "West", D(2016, 2, 5), False, 50, 5, 5),
        ("C", "First Class", "East", D(2017, 1, 5), False, 10, -1, 0),
        ("D", "First Class", "East", D(2017, 1, 9), True, 30, 9, 3),
        ("E", "First Class", "West", D(2017, 3, 1), False, 0, 0, 0),
    )


@pytest.fixture(scope="module")
def memberships(spark):
    rows = [("A", "Paper"), ("A", "Paper"), ("A", "Art"), ("B", "Paper"), ("C", "Art"), ("D", "Art")]
    return spark.createDataFrame(rows, "order_id string, sub_category string")


def test_regions_come_in_the_given_order(sample):
    rows = diagnostics.region_volume(sample, ["West", "East"]).collect()
    assert [tuple(r) for r in rows] == [("West", 3, 1, 1 / 3), ("East", 2, 1, 0.5)]


def test_missing_region_fails(sample):
    with pytest.raises(Exception, match="No rows for region: South"):
        diagnostics.region_volume(sample, ["West", "South"]).collect()


def test_overall_rate_and_trend(sample):
    assert diagnostics.overall_rate(sample).first().late_rate == 0.4
    rows = [tuple(r)[:4] for r in diagnostics.mode_year_trend(sample).collect()]
    assert rows == [("First Class", 2017, 3, 1), ("Same Day", 2016, 2, 1)]
    assert [tuple(r)[:3] for r in diagnostics.year_rates(sample).collect()] == [(2016, 2, 1), (2017, 3, 1)]


def test_order_counts_once_per_member_value(sample, memberships):
    rates = diagnostics.member_rates(memberships, sample, "sub_category")
    assert {r.sub_category: (r.orders, r.late_orders) for r in rates.collect()} == {
        "Paper": (2, 1), "Art": (3, 2)
    }
    assert diagnostics.member_rates(memberships, sample, "sub_category", 3).count() == 1


def test_hotspots_merge_both_lists_and_mark_the_leader(sample, memberships):
    rows = diagnostics.hotspots(memberships, sample, minimum=1, by_rate=2).collect()
    # Cells: Art/First/East 1 of 2, Art/Same/West 1 of 1, Paper/Same/West 1 of 2.
    assert [(r.label, r.is_leader) for r in rows] == [
        ("Art · First Class · East", True), ("Art · Same Day · West", False)
    ]
    only_rate = diagnostics.hotspots(memberships, sample, minimum=1, by_rate=1).collect()
    assert [(r.sub_category, r.ship_mode, r.is_leader) for r in only_rate] == [
        ("Art", "First Class", True), ("Art", "Same Day", False)
    ]


def test_ties_in_a_ranking_go_by_value(spark):
    rates = spark.createDataFrame(
        [("b", 10, 0.5), ("a", 10, 0.5), ("c", 12, 0.5), ("d", 1, 0.1)],
        "k string, orders long, late_rate double",
    )
    rows = diagnostics.both_ends(rates, "k", 2, 2).collect()
    assert [(r.k, r.end) for r in rows] == [("c", "high"), ("a", "high"), ("d", "low"), ("c", "low")]


def test_top_months_need_volume(sample):
    rows = diagnostics.top_months(sample, minimum=2).collect()
    assert [tuple(r) for r in rows] == [("2017-01", 2, 1, 0.5)]


def test_late_against_on_time_averages_order_ratios(sample):
    rows = {r.is_late: r for r in diagnostics.late_against_on_time(sample).collect()}
    assert rows[True].avg_weighted_discount == pytest.approx(0.15, abs=1e-12)  # (0.2 + 0.1) / 2
    assert rows[True].avg_margin == pytest.approx(0.2, abs=1e-12)  # (0.1 + 0.3) / 2
    assert rows[True].avg_order_profit == 9.5
    # An order without sales has no ratio but still counts.
    assert rows[False].orders == 3 and rows[False].avg_weighted_discount == pytest.approx(0.05, abs=1e-12)
    assert rows[False].avg_margin == 0.0


def test_correlation_without_variance_is_null(spark, sample):
    on_time = sample.where(~F.col("is_late"))
    assert {r.correlation for r in diagnostics.late_correlations(on_time).collect()} == {None}
    assert diagnostics.region_year_correlation(sample.limit(0)).first().correlation is None


def test_correlations(sample):
    found = {r.measure: r.correlation for r in diagnostics.late_correlations(sample).collect()}
    late, profit = [1, 0, 0, 1, 0], [10, 5, -1, 9, 0]
    assert found["order_profit"] == pytest.approx(pearson(late, profit), abs=1e-9)
    discount = [0.2, 0.1, 0.0, 0.1]
    assert found["weighted_discount"] == pytest.approx(pearson(late[:4], discount), abs=0.2)
    whole = diagnostics.region_year_correlation(sample).first()
    assert whole.observations == 3
    assert whole.correlation == pytest.approx(pearson([2, 2, 1], [0.5, 0.5, 0.0]), abs=1e-9)
    within = {r.region: r for r in diagnostics.within_region_correlation(sample).collect()}
    assert within["East"].correlation is None and within["West"].correlation == pytest.approx(1.0, abs=1e-12)


def pearson(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return sxy / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
