"""One order and one product that hold most lines must not end in one task."""

import glob
import re

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from harborline import session
from harborline.plans import queries
from harborline.plans.oracle import ORACLE
from harborline.plans.queries import QUERIES
from harborline.sources.order_tables import OrderTables

SETTINGS = {
    # Force the joins a large cluster would pick, and call small partitions skewed.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    hot = F.col("id") % 3 != 0
    tables = {
        "lineitem": spark.range(0, 40_000, 1, 6).select(
            F.when(hot, 7).otherwise(F.col("id") % 2000).alias("l_orderkey"),
            F.when(hot, 3).otherwise(F.col("id") % 50).alias("l_partkey"),
            F.col("id").alias("l_suppkey"),
            F.lit(1).alias("l_linenumber"),
            (1 + F.col("id") % 9).cast("double").alias("l_quantity"),
            (F.col("id") % 1000 + 0.25).cast("double").alias("l_extendedprice"),
            F.lit(0.05).cast("double").alias("l_discount"),
            F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(id % 900 as int))").alias("l_shipdate"),
        ),
        "orders": spark.range(0, 2000, 1, 2).select(
            F.col("id").alias("o_orderkey"),
            (F.col("id") % 40).alias("o_custkey"),
            F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(id % 500 as int))").alias("o_orderdate"),
            F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])),
                         (F.col("id") % 4 + 1).cast("int")).alias("o_orderpriority"),
        ),
        "customer": spark.range(40).select(
            F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"),
            (F.col("id") % 5).cast("int").alias("c_nationkey"), F.lit("S").alias("c_mktsegment"),
        ),
        "nation": spark.range(5).select(
            F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("n"), "id").alias("n_name"),
            F.col("id").cast("int").alias("n_regionkey"),
        ),
        "region": spark.range(5).select(
            F.col("id").cast("int").alias("r_regionkey"),
            F.element_at(F.array(*map(F.lit, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])),
                         (F.col("id") + 1).cast("int")).alias("r_name"),
        ),
        "part": spark.range(50).select(
            F.col("id").alias("p_partkey"), F.concat(F.lit("p"), "id").alias("p_name"),
            F.concat(F.lit("b"), F.col("id") % 7).alias("p_brand"), F.lit("T").alias("p_type"),
            (F.col("id") % 3).cast("int").alias("p_size"), F.lit(1.5).cast("double").alias("p_retailprice"),
        ),
    }
    for name, df in tables.items():
        # One file each for the small tables, which keeps them below a threshold.
        stored = df if name in ("lineitem", "orders") else df.coalesce(1)
        stored.write.parquet(f"{folder}/{name}.parquet")
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(folder)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


LINE_JOINS = {
    "accepted": lambda t: t.accepted_lines(),
    "canonical": lambda t: t.canonical_lines(),
    "raw": lambda t: t.raw_lines(),
    "order_facts": lambda t: t.order_facts(),
}


@pytest.mark.parametrize("name", LINE_JOINS)
def test_hot_order_is_split_in_the_join(spark, skewed, name):
    plan = final_plan(LINE_JOINS[name](OrderTables(spark, skewed)))
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("name", LINE_JOINS)
def test_hot_order_is_split_when_small_tables_are_broadcast(spark, skewed, name):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "8KB")
    try:
        plan = final_plan(LINE_JOINS[name](OrderTables(spark, skewed)))
    finally:
        spark.conf.set(threshold, "-1")
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in final
    assert "BroadcastHashJoin" in final


@pytest.mark.parametrize(
    "name",
    ["order_financials", "summary_by_region", "summary_grouping_sets", "fact_orders",
     "fact_order_lines_star", "dq_inconsistent_orders", "subcategory_hotspots", "reconcile_clean"],
)
def test_results_hold_under_skew(spark, skewed, name):
    con = connect(skewed)
    assert differences(QUERIES[name](spark, skewed), con, ORACLE[name]) == []


def test_hot_order_is_folded_before_the_extra_exchange(spark, skewed):
    """With parts broadcast, nothing but the split itself separates join and sum."""
    t = OrderTables(spark, skewed)
    lines = t.accept(t.described(F.broadcast(t.products())), t._headers())
    totals = lines.groupBy("order_id").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    plan = final_plan(totals).split("== Initial Plan ==")[0]
    assert "SortMergeJoin(skew=true)" in plan and "BroadcastHashJoin" in plan
    order = [plan.index(step) for step in ("HashAggregate", "Exchange", "SortMergeJoin(skew=true)")]
    assert order == sorted(order) and plan[: order[2]].count("HashAggregate") == 2
    plain = spark.read.parquet(f"{skewed}/lineitem.parquet").join(
        spark.read.parquet(f"{skewed}/orders.parquet"), F.expr("l_orderkey = o_orderkey")
    ).where("l_shipdate >= o_orderdate").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    assert sorted(totals.collect()) == sorted(plain.collect())


@pytest.fixture(scope="module")
def hot_customer(skewed, spark, tmp_path_factory):
    """Two thirds of the orders belong to one customer; every order has one line."""
    folder = tmp_path_factory.mktemp("hot-customer")
    for name in ("nation", "region", "part"):
        spark.read.parquet(f"{skewed}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.range(5000).select(
        F.col("id").alias("c_custkey"), F.concat(F.lit("c"), "id").alias("c_name"),
        (F.col("id") % 5).cast("int").alias("c_nationkey"), F.lit("S").alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 240_000, 1, 6).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id") % 5000).alias("o_custkey"),
        F.expr("timestamp_ntz'1996-01-01' + make_dt_interval(cast(id % 500 as int))").alias("o_orderdate"),
        F.lit("1-URGENT").alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(0, 240_000, 1, 6).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"), F.col("id").alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.lit(2.0).alias("l_quantity"), F.lit(10.0).alias("l_extendedprice"),
        F.lit(0.0).alias("l_discount"),
        F.expr("timestamp_ntz'1997-08-01' + make_dt_interval(cast(id % 90 as int))").alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_hot_customer_is_split_in_its_own_join(spark, hot_customer):
    plan = final_plan(OrderTables(spark, hot_customer).orders(place=True))
    final = plan.split("== Initial Plan ==")[0]
    assert re.search(r"SortMergeJoin\(skew=true\) \[customer_id#", final), final


@pytest.mark.parametrize("name", ["summary_by_region", "fact_order_lines_star", "dim_customer"])
def test_results_hold_with_a_hot_customer(spark, hot_customer, name):
    assert differences(QUERIES[name](spark, hot_customer), connect(hot_customer), ORACLE[name]) == []


def test_only_accepted_lines_meet_product_text(spark, skewed):
    """The exchange by order carries lines as they are stored; products join last."""
    plan = OrderTables(spark, skewed).canonical_lines()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "part_key" in joins[0] and "order_id" in joins[1], plan


@pytest.mark.parametrize("name", ["csv_roundtrip", "load_order_lines"])
def test_text_that_is_read_again_is_compressed(spark, skewed, name, monkeypatch):
    written = []

    def noted(spark, name):
        written.append(session.fresh_path(spark, name))
        return written[-1]

    monkeypatch.setattr(queries, "fresh_path", noted)
    assert differences(QUERIES[name](spark, skewed), connect(skewed), ORACLE[name]) == []
    assert glob.glob(f"{written[-1]}/*.csv.gz") and not glob.glob(f"{written[-1]}/*.csv")
