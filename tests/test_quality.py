import datetime as dt
from decimal import Decimal

import pytest
from fixtures import lines

from harborline import schema
from harborline.operators import quality, scenarios
from harborline.operators.quality import QualityError

D = dt.date


@pytest.fixture(scope="module")
def modes(spark):
    return scenarios.days_of(scenarios.scenario_table(spark), "base")


def test_clean_lines_pass(spark, modes):
    quality.validate(lines(spark, {}, {"order_id": "B"}), modes, expected_rows=2)


@pytest.mark.parametrize("column", ["row_id", "customer_name", "segment", "profit"])
def test_missing_columns_are_named(spark, modes, column):
    with pytest.raises(QualityError, match=f"Missing columns: {column}"):
        quality.validate(lines(spark).drop(column), modes, expected_rows=None)


@pytest.mark.parametrize(
    "changes, message",
    [
        ([{"row_id": None}], "row_id_null: 1 rows"),
        ([{"row_id": "7"}, {"row_id": "7"}], "Source is not unique on row_id: 7"),
        ([{"customer_name": None}], "null_values: 1 rows"),
        ([{"ship_date": D(2017, 1, 2)}], "ship_before_order: 1 rows"),
        ([{"sales": Decimal("-0.01")}], "negative_sales"),
        ([{"quantity": 0}], "quantity_not_positive"),
        ([{"discount": Decimal("1.000001")}], "discount_outside_0_1"),
        ([{"discount": Decimal("-0.1")}], "discount_outside_0_1"),
        ([{"ship_mode": "Drone"}, {"ship_mode": "Boat"}], "Unknown ship modes: Boat, Drone"),
        ([{}, {"order_date": D(2017, 1, 4)}], "inconsistent within order_id: A"),
        ([{}, {"city": "Bend"}], "inconsistent within order_id: A"),
    ],
)
def test_each_violation_is_raised(spark, modes, changes, message):
    with pytest.raises(QualityError, match=message):
        quality.validate(lines(spark, *changes), modes, expected_rows=None)


def test_row_count_is_checked_when_given(spark, modes):
    with pytest.raises(QualityError, match="Expected 9994 rows, found 1"):
        quality.validate(lines(spark), modes)


def test_first_violation_in_contract_order_wins(spark, modes):
    broken = lines(spark, {"quantity": 0, "sales": Decimal(-1), "ship_date": D(2016, 1, 1)})
    with pytest.raises(QualityError, match="ship_before_order"):
        quality.validate(broken, modes, expected_rows=None)


def test_report_lists_every_check(spark, modes):
    broken = lines(spark, {"quantity": 0}, {"sales": Decimal(-1), "ship_mode": "Drone"})
    found = {r.check_name: r.violations for r in quality.report(broken, modes, 3).collect()}
    assert found == {
        "row_count": 2, "row_id_null": 0, "null_values": 0, "ship_before_order": 0,
        "negative_sales": 1, "quantity_not_positive": 1, "discount_outside_0_1": 0,
        "row_count_difference": 1, "row_id_duplicated": 0, "unknown_ship_modes": 1,
        "inconsistent_orders": 1,
    }


def test_null_counts_as_a_value_in_consistency(spark):
    df = lines(spark, {"region": None}, {}, {"order_id": "B", "region": None},
               {"order_id": "B", "region": None})
    found = quality.inconsistent_groups(df, ["order_id"], schema.ORDER_FIELDS).collect()
    assert [tuple(r) for r in found] == [("A", 2)]


def test_messages_name_a_bounded_number_of_offenders(spark):
    df = spark.range(100).selectExpr("id % 50 AS k")
    with pytest.raises(QualityError) as error:
        quality.require_unique(df, ["k"], "t")
    assert str(error.value).count(",") < 25 and str(error.value).endswith("and more")


def test_dimension_conflicts(spark):
    df = lines(spark, {}, {"product_name": "Other"}, {"product_id": "P2"})
    found = quality.inconsistent_groups(df, ["product_id"], ["product_name"]).collect()
    assert [tuple(r) for r in found] == [("P1", 2)]


def test_null_counts(spark):
    found = quality.null_counts(lines(spark, {"city": None}, {})).collect()
    assert {r.column_name: r.violations for r in found if r.violations} == {"city": 1}
    assert len(found) == 21


def test_unmatched_rows_and_count_comparison(spark):
    left = spark.range(3).withColumnRenamed("id", "k")
    right = spark.range(2).withColumnRenamed("id", "k")
    assert quality.rows_without_match(left, right, ["k"]).collect() == [(2,)]
    pair = {"rows": (left.selectExpr("count(*)"), right.selectExpr("count(*)"))}
    assert [tuple(r) for r in quality.compare_counts(pair).collect()] == [("rows", 3, 2, False)]


def test_a_message_names_as_many_offenders_as_asked(spark):
    df = spark.range(50).selectExpr("id % 25 AS k")
    for named, count, more in ((3, 3, True), (None, 25, False), (25, 25, False)):
        with pytest.raises(quality.QualityError) as error:
            quality.require_unique(df, ["k"], "Rows", named)
        text = str(error.value).split(": ")[1]
        assert text.endswith(" and more") == more and len(text.removesuffix(" and more").split(", ")) == count
