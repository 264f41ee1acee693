import datetime as dt
from decimal import Decimal

import pytest
from fixtures import lines, small_lines
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline import config, schema
from harborline.operators import facts, scenarios, star
from harborline.operators.keys import dense_key
from harborline.operators.quality import QualityError

D = dt.date


def build(spark, df, **options):
    return facts.build_orders(df, scenarios.scenario_table(spark), config.HOLIDAYS, **options)


def test_financials_are_summed_once_per_order(spark):
    rows = {r.order_id: r for r in facts.order_financials(small_lines(spark)).collect()}
    assert (rows["A"].order_sales, rows["A"].order_profit, rows["A"].order_line_count) == (15, 3, 2)


def test_lines_collapse_to_one_order(spark):
    orders = build(spark, lines(spark, {}, {"product_id": "P2"}))
    assert orders.columns == schema.FACT_ORDERS
    (row,) = orders.collect()
    assert (row.calendar_days_to_ship, row.business_days_to_ship) == (2, 2)
    assert (row.sla_days, row.sla_variance, row.is_late) == (2, 0, False)
    assert row.postal_code == "01234"


def test_inconsistent_orders_are_rejected(spark):
    with pytest.raises(QualityError, match="inconsistent within order_id: A"):
        build(spark, lines(spark, {}, {"order_date": D(2017, 1, 4)}))


def test_classification_against_base_thresholds(spark):
    df = spark.createDataFrame(
        [("Same Day", 0), ("First Class", 2), ("Standard Class", 5)],
        "ship_mode string, business_days_to_ship int",
    )
    days = scenarios.days_of(scenarios.scenario_table(spark), "base")
    found = {r.ship_mode: tuple(r)[2:] for r in scenarios.with_threshold(df, days).collect()}
    assert found == {
        "Same Day": (0, 0, False), "First Class": (1, 1, True), "Standard Class": (5, 0, False)
    }


def test_unknown_mode_fails(spark):
    df = spark.createDataFrame([("Drone", 1)], "ship_mode string, business_days_to_ship int")
    table = scenarios.scenario_table(spark)
    with pytest.raises(Exception, match="Unknown ship modes: Drone"):
        scenarios.with_threshold(df, scenarios.days_of(table, "base")).collect()
    with pytest.raises(Exception, match="Unknown ship modes: Drone"):
        scenarios.classify(df, table).collect()


def test_one_pass_order_facts_agree_with_separate_ones(spark):
    df = lines(
        spark,
        {"sales": Decimal(10), "discount": Decimal("0.5")},
        {"sales": Decimal(30), "discount": Decimal("0.1")},
        {"order_id": "B", "ship_date": D(2017, 1, 9)},
    )
    fields = [f for f in schema.ORDER_FIELDS if f != "ship_date"]
    together = facts.order_facts(df, fields)
    apart = facts.collapse(df).join(facts.order_financials(df), "order_id")
    names = sorted(apart.columns)
    assert sorted(together.select(names).collect()) == sorted(apart.select(names).collect())
    assert together.where("order_id = 'A'").first().order_discount_value == Decimal(8)


def test_star_schema(spark):
    df = lines(
        spark,
        {"sales": Decimal(10)},
        {"product_id": "P2", "category": "Office Supplies", "sub_category": "Paper",
         "sales": Decimal(20), "quantity": 2, "discount": Decimal("0.1"), "profit": Decimal(4)},
    )
    tables = star.build(df)
    assert sorted(tables) == [
        "dim_customer", "dim_date", "dim_location", "dim_product", "dim_ship_mode",
        "fact_order_lines_star",
    ]
    fact = tables["fact_order_lines_star"]
    assert fact.columns == schema.STAR_FACT
    rows = fact.orderBy("row_id").collect()
    assert len(rows) == 2 and {r.customer_key for r in rows} == {1}
    assert [r.product_key for r in rows] == [1, 2]
    assert {(r.order_date_key, r.ship_date_key) for r in rows} == {(20170103, 20170105)}
    assert tables["dim_date"].count() == 3


def test_colliding_product_ids_get_their_own_keys(spark):
    tables = star.build(lines(spark, {}, {"order_id": "B", "product_name": "Product Two"}))
    products = tables["dim_product"].collect()
    assert {p.product_id for p in products} == {"P1"}
    assert sorted(p.product_key for p in products) == [1, 2]
    assert tables["fact_order_lines_star"].select("product_key").distinct().count() == 2


def test_conflicting_customer_attributes_are_rejected(spark):
    with pytest.raises(QualityError, match="conflicting attributes.*C1"):
        star.build_dimension(lines(spark, {}, {"segment": "Corporate"}), "dim_customer")


def test_null_parts_of_a_composite_key_match(spark):
    df = lines(spark, {"postal_code": None}, {})
    keys = star.build(df)["fact_order_lines_star"].select("location_key").collect()
    assert sorted(r.location_key for r in keys) == [1, 2]


def test_unmatched_star_key_fails(spark):
    df = lines(spark)
    tables = star.build(df)
    with pytest.raises(Exception, match="No dimension row for customer_key"):
        star.build_fact(lines(spark, {"customer_id": "C9"}), tables).collect()


def test_dense_keys_over_many_partitions_equal_a_global_numbering(spark):
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).selectExpr("cast(id * 7919 % 20011 as string) AS a", "id AS b")
        keyed = dense_key(rows, ["a", "b"], "k")
        wanted = rows.withColumn("k", F.row_number().over(W.orderBy("a", "b")))
        assert keyed.select("a", "b", "k").exceptAll(wanted.selectExpr("a", "b", "cast(k as bigint)")).isEmpty()
        assert keyed.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


def test_dense_keys_of_nothing(spark):
    assert dense_key(spark.range(0), ["id"], "k").count() == 0


def test_colliding_codes_take_another_seed(spark, monkeypatch):
    """Two places that share a code are told apart, and each line gets its own keys."""
    real, seeds = star.code, []

    def weak(columns, seed):
        seeds.append(seed)
        if seed == 0:
            return F.struct(F.lit(1).cast("bigint").alias("high"), F.lit(2).cast("bigint").alias("low"))
        return real(columns, seed)

    df = lines(spark, {}, {"order_id": "B", "city": "Elsewhere", "product_id": "P2"}, {"order_id": "C", "city": None})
    expected = {(r.order_id, r.location_key, r.product_key) for r in star.build(df)["fact_order_lines_star"].collect()}
    monkeypatch.setattr(star, "code", weak)
    fact = star.build(df)["fact_order_lines_star"]
    assert {(r.order_id, r.location_key, r.product_key) for r in fact.collect()} == expected
    assert len(expected) == 3 and len({k for _, k, _ in expected}) == 3 and 1 in seeds


def test_nulls_are_values_of_codes(spark):
    rows = [("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(star.code(["x", "y"], 0).alias("c")).distinct().count() == len(rows)


def test_lines_carry_codes_instead_of_text(spark):
    """No natural column of a dimension crosses an exchange together with a line."""
    df = lines(spark, {}, {"order_id": "B", "product_id": "P2"})
    tables = {"dim_date": star.build_dates(df)}
    tables |= {name: star.build_dimension(df, name) for name in star.DIMENSIONS}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = star.build_fact(df, tables)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def exchanged(node):
        if node.nodeName().startswith("Exchange"):
            yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from exchanged(node.children().apply(i))

    of_lines = [names for names in exchanged(plan) if "row_id" in names]
    assert len(of_lines) == 2
    for names in of_lines:
        assert not names & {*schema.LOCATION, *schema.PRODUCT, "customer_id", "ship_mode"}


def test_dimensions_are_built_from_their_own_members(spark, monkeypatch):
    """Two places of two customers each: no stored tuple combines dimensions."""
    stored, real = {}, star.materialise

    def noted(df, name):
        stored[name] = set(df.columns)
        return real(df, name)

    monkeypatch.setattr(star, "materialise", noted)
    changes = [{"order_id": f"{c}{p}", "customer_id": c, "city": p} for c in "AB" for p in "XY"]
    fact = star.build(lines(spark, *changes))["fact_order_lines_star"]
    found = {r.order_id: (r.customer_key, r.location_key) for r in fact.collect()}
    assert found == {"AX": (1, 1), "AY": (1, 2), "BX": (2, 1), "BY": (2, 2)}
    expected = [{*natural, *attributes} for _, natural, attributes in star.DIMENSIONS.values()]
    assert len(stored) == 4 and all(columns in expected for columns in stored.values())


def test_codes_of_lines_are_one_number_until_they_collide(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    kinds = [df.select(star.code(["x", "y"], seed).alias("c")).schema["c"].dataType.simpleString() for seed in range(5)]
    assert kinds == ["bigint"] * 3 + ["struct<high:bigint,low:bigint>"] * 2
