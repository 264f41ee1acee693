import datetime as dt

import pytest
from fixtures import small_lines, small_orders
from pyspark.sql import functions as F

from harborline import config, schema
from harborline.operators import facts, scenarios, summaries
from harborline.operators.quality import QualityError
from harborline.plans import pipeline

D = dt.date
EXTRA_ORDER = ("D", D(2017, 3, 6), "Second Class", "Central", 2, 2, 0, False)


def detail(spark, orders=None, lines=None):
    totals = scenarios.attach_financials(
        orders if orders is not None else small_orders(spark),
        facts.order_financials(lines if lines is not None else small_lines(spark)),
    )
    return scenarios.expand(totals, scenarios.scenario_table(spark))


def by_scenario(df):
    return {(r.scenario, r.order_id): r for r in df.collect()}


def test_scenario_table_has_sixteen_unique_rows(spark):
    rows = scenarios.scenario_table(spark).collect()
    assert len(rows) == len({(r.scenario, r.ship_mode) for r in rows}) == 16
    found = {s: {r.ship_mode: r.scenario_sla_days for r in rows if r.scenario == s}
             for s in config.SCENARIOS}
    assert [list(found[s].values()) for s in config.SCENARIOS] == [
        [0, 1, 2, 5], [0, 2, 3, 4], [0, 1, 2, 3], [0, 3, 4, 5]
    ]


def test_equality_is_on_time_and_same_day_stays_zero(spark):
    rows = by_scenario(detail(spark))
    assert not rows["base", "A"].is_late
    assert rows["strict", "A"].scenario_sla_days == 3 and rows["strict", "A"].is_late
    assert rows["lenient", "C"].scenario_sla_days == 0 and not rows["lenient", "C"].is_late


def test_calibrated_thresholds(spark):
    rows = by_scenario(detail(spark))
    assert rows["calibrated", "A"].scenario_sla_days == 4 and rows["calibrated", "A"].is_late
    assert rows["calibrated", "B"].scenario_sla_days == 2 and not rows["calibrated", "B"].is_late
    assert rows["calibrated", "C"].scenario_sla_days == 0


def test_strict_and_lenient_keep_modes_distinct(spark):
    lines = small_lines(spark).unionByName(
        spark.createDataFrame([("5", "D", "12", "2")], "row_id string, order_id string, sales string, profit string")
        .withColumns({c: F.col(c).cast(schema.MONEY) for c in ("sales", "profit")})
    )
    rows = detail(spark, small_orders(spark, EXTRA_ORDER), lines).collect()
    for scenario, days in {"strict": [0, 1, 2, 3], "lenient": [0, 3, 4, 5]}.items():
        found = {r.ship_mode: r.scenario_sla_days for r in rows if r.scenario == scenario}
        assert found == dict(zip(config.SHIP_MODES, days))


def test_late_same_day_is_late_in_every_scenario(spark):
    orders = small_orders(spark).withColumn(
        "business_days_to_ship", F.when(F.col("order_id") == "C", 1).otherwise(F.col("business_days_to_ship"))
    )
    rows = [r for r in detail(spark, orders).collect() if r.order_id == "C"]
    assert [r.scenario_sla_days for r in rows] == [0] * 4 and all(r.is_late for r in rows)


def test_base_threshold_is_kept_under_every_scenario(spark):
    rows = by_scenario(detail(spark))
    assert {rows[s, "A"].base_sla_days for s in config.SCENARIOS} == {5}
    assert {rows[s, "A"].base_sla_variance for s in config.SCENARIOS} == {0}
    assert rows["strict", "A"].late_order_sales == 15 and rows["base", "A"].late_order_sales == 0
    assert rows["base", "A"].order_month == D(2017, 1, 1)
    assert rows["base", "A"].order_month_label == "2017-01"


def test_order_without_lines_fails(spark):
    with pytest.raises(Exception, match="No order lines for order D"):
        detail(spark, small_orders(spark, EXTRA_ORDER)).collect()


def test_duplicated_order_is_rejected(spark):
    twice = small_orders(spark).unionByName(small_orders(spark))
    with pytest.raises(QualityError, match="Order fact is not unique on order_id: A, B, C"):
        pipeline.analyze(twice, small_lines(spark))


@pytest.mark.parametrize("dims", [[], ["ship_mode"], ["region"], ["ship_mode", "region"]])
def test_both_summary_forms_agree_in_rows_and_order(spark, dims):
    totals = scenarios.attach_financials(
        small_orders(spark), facts.order_financials(small_lines(spark))
    )
    table = scenarios.scenario_table(spark)
    direct = summaries.summarize(scenarios.expand(totals, table), dims)
    folded = summaries.summarize_orders(totals, table, dims)
    assert direct.columns == folded.columns == ["scenario", *dims, *schema.SUMMARY_MEASURES]
    assert direct.collect() == folded.collect()


def test_summary_by_mode(spark):
    summary = pipeline.analyze(small_orders(spark), small_lines(spark))["by_ship_mode"]
    rows = summary.collect()
    assert list(dict.fromkeys(r.scenario for r in rows)) == config.SCENARIOS
    assert [r.ship_mode for r in rows[:3]] == ["First Class", "Same Day", "Standard Class"]
    first = rows[0]
    assert (first.orders, first.late_orders, first.late_order_rate) == (1, 1, 1.0)
    assert (first.late_order_sales, first.late_order_profit) == (20, -3)


def test_group_without_late_orders_has_zero_money(spark):
    rows = summaries.summarize(detail(spark), ["ship_mode"]).where("ship_mode = 'Same Day'").collect()
    assert {r.late_order_sales for r in rows} == {0} and {r.late_order_rate for r in rows} == {0.0}


def test_grouping_sets_agree_with_the_families(spark):
    totals = scenarios.attach_financials(
        small_orders(spark), facts.order_financials(small_lines(spark))
    ).withColumn("order_month", F.trunc("order_date", "month"))
    table = scenarios.scenario_table(spark)
    together = summaries.summarize_families(totals, table)
    for name, dims in summaries.FAMILIES.items():
        alone = summaries.summarize_orders(totals, table, dims)
        picked = together.where(F.col("family") == name).select(*alone.columns)
        assert sorted(picked.collect()) == sorted(alone.collect())


def test_null_dimension_sorts_last(spark):
    orders = small_orders(spark).withColumn(
        "region", F.when(F.col("order_id") != "B", F.col("region"))
    )
    rows = summaries.summarize(detail(spark, orders), ["region"]).collect()
    assert [r.region for r in rows[:2]] == ["West", None]
