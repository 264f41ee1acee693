import os

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from harborline.plans.oracle import ORACLE
from harborline.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Queries with a minimum volume need the larger tables to return anything.
LARGER = "/root/testdata/sf0.01"
MINIMUM_VOLUME = ["state_rates", "state_extremes", "subcategory_rates", "subcategory_extremes",
                  "top_months", "subcategory_hotspots"]
# Offenders that clean tables do not hold.
EMPTY = {"dq_duplicate_keys", "dq_unknown_modes"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    folder = LARGER if name in MINIMUM_VOLUME else FOLDER
    found = con if folder == FOLDER else connect(folder)
    assert differences(QUERIES[name](spark, folder), found, ORACLE[name]) == []
    assert name in EMPTY or found.execute(ORACLE[name]).fetchone()


def test_planted_faults_are_reported(con):
    """The comparisons that must fail do, whatever both sides agree on."""
    failed = con.execute(ORACLE["reconcile_duplicated_line"]).fetchall()
    assert len(failed) == 4 and all(failures for _, _, failures in failed)
    unequal = {name for name, *_, equal in con.execute(ORACLE["dq_grain_missing_lines"]).fetchall() if not equal}
    assert unequal == {"orders_in_both_facts", "financials_per_order", "orders_without_financials"}


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r.scenario for r in rows] == ["base", "calibrated", "strict", "lenient"]
