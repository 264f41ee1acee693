from decimal import Decimal

import pytest

from harborline import schema
from harborline.operators.reconcile import failures, reconcile

KINDS = "scenario string, " + ", ".join(
    [f"{c} long" for c in schema.SUMMARY_COUNTS]
    + [f"{c} decimal(38,7)" for c in schema.SUMMARY_MONEY]
    + [f"{c} double" for c in schema.SUMMARY_RATES]
)


def table(spark, **rows):
    """scenario -> changes to a standard row"""
    standard = {
        **dict.fromkeys(schema.SUMMARY_COUNTS, 5),
        **dict.fromkeys(schema.SUMMARY_MONEY, Decimal(10)),
        **dict.fromkeys(schema.SUMMARY_RATES, 0.5),
    }
    data = [(s, *({**standard, **change}[c] for c in standard)) for s, change in rows.items()]
    return spark.createDataFrame(data, KINDS)


@pytest.mark.parametrize(
    "change, matches",
    [
        ({}, True),
        ({"orders": 6}, False),
        ({"total_sales": Decimal("10.000001")}, False),
        ({"total_sales": Decimal("10.0000001")}, False),
        ({"late_order_rate": 0.5 + 1e-13}, True),
        ({"late_order_rate": 0.5 + 1e-11}, False),
        ({"total_profit": None}, False),
    ],
)
def test_tolerances(spark, change, matches):
    compared = reconcile(table(spark, base={}), table(spark, base=change), ["scenario"])
    assert [tuple(r) for r in compared.collect()] == [("base", matches)]


def test_rows_on_one_side_are_mismatches(spark):
    compared = reconcile(table(spark, base={}, strict={}), table(spark, base={}, lenient={}), ["scenario"])
    assert {r.scenario: r.matches for r in compared.collect()} == {
        "base": True, "strict": False, "lenient": False
    }
    assert [tuple(r) for r in failures({"overall": compared}).collect()] == [("overall", 3, 2)]


def test_money_of_any_size_is_compared_exactly(spark):
    big = Decimal(10) ** 20
    left, right = table(spark, base={"total_sales": big}), table(spark, base={"total_sales": big})
    assert reconcile(left, right, ["scenario"]).first().matches
    off = table(spark, base={"total_sales": big + Decimal("0.0001")})
    assert not reconcile(left, off, ["scenario"]).first().matches


def test_measures_side_by_side(spark):
    compared = reconcile(
        table(spark, base={}), table(spark, base={"late_orders": 7}), ["scenario"], show=["late_orders"]
    )
    assert compared.collect()[0].asDict() == {
        "scenario": "base", "matches": False, "left_late_orders": 5, "right_late_orders": 7
    }
