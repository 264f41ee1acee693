"""The query catalogue over the normalised order tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline import config, schema, session
from harborline.functions.calendar import date_bounds, date_dimension
from harborline.functions.columns import days_between
from harborline.operators import (
    diagnostics,
    facts,
    quality,
    reconcile,
    scenarios,
    star,
    summaries,
)
from harborline.plans import pipeline, sql_path
from harborline.session import fresh_path, materialise
from harborline.sources import files
from harborline.sources import order_tables as source
from harborline.sources.order_tables import OrderTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Text of order lines that is read again at once; it shrinks to about a fifth.
TEXT_CODEC = "gzip"


def query(build: Callable[[OrderTables], DataFrame]) -> Callable[[OrderTables], DataFrame]:
    """Register a query under its function name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables = OrderTables(session.tune(spark), folder)
        session.size_for(spark, tables.path("lineitem"), spread=session.SPREAD)
        return build(tables)

    QUERIES[build.__name__] = run
    return build


# -- facts ----------------------------------------------------------------------


@query
def canonical_lines(t: OrderTables) -> DataFrame:
    return t.canonical_lines()


@query
def business_days(t: OrderTables) -> DataFrame:
    counted = t.counted(t.orders())
    calendar_days = days_between("order_date", "ship_date").alias("calendar_days_to_ship")
    return counted.select(
        "order_id", "order_date", "ship_date", calendar_days, "business_days_to_ship"
    )


@query
def fact_orders(t: OrderTables) -> DataFrame:
    """Orders come from their one header row, so no line has to be folded again."""
    orders = facts.with_sla(t.orders(place=True), t.scenarios())
    return orders.select(*schema.FACT_ORDERS)


@query
def order_financials(t: OrderTables) -> DataFrame:
    return facts.order_financials(t.accepted_lines())


@query
def shipment_lateness(t: OrderTables) -> DataFrame:
    lines = t.shipped_lines()
    shipments = lines.select("order_id", "order_date", "ship_mode", "line_ship_date").distinct()
    dated = shipments.withColumnRenamed("line_ship_date", "ship_date")
    rated = scenarios.with_threshold(t.counted(dated), scenarios.days_of(t.scenarios(), "base"))
    return rated.withColumnRenamed("ship_date", "line_ship_date")


# -- scenarios and summaries ------------------------------------------------------


@query
def scenario_orders(t: OrderTables) -> DataFrame:
    orders = facts.with_sla(t.order_facts(place=True), t.scenarios())
    detail = scenarios.expand(orders, t.scenarios())
    return detail.drop("order_discount_value", *schema.CUSTOMER_ATTRIBUTES)


@query
def summary_overall(t: OrderTables) -> DataFrame:
    return summaries.summarize_orders(t.counted(t.order_facts()), t.scenarios())


@query
def summary_by_ship_mode(t: OrderTables) -> DataFrame:
    return summaries.summarize_orders(t.counted(t.order_facts()), t.scenarios(), ["ship_mode"])


@query
def summary_by_region(t: OrderTables) -> DataFrame:
    orders = t.counted(t.order_facts(place=True))
    return summaries.summarize_orders(orders, t.scenarios(), ["region"])


def _with_month(t: OrderTables, orders: DataFrame) -> DataFrame:
    return t.counted(orders).withColumn("order_month", F.trunc("order_date", "month"))


@query
def summary_by_month(t: OrderTables) -> DataFrame:
    orders = _with_month(t, t.order_facts())
    return summaries.summarize_orders(orders, t.scenarios(), ["order_month"])


@query
def summary_grouping_sets(t: OrderTables) -> DataFrame:
    orders = _with_month(t, t.order_facts(place=True))
    return summaries.summarize_families(orders, t.scenarios())


@query
def summary_distinct_orders(t: OrderTables) -> DataFrame:
    """By ship mode from the two facts joined one to one, counting distinct orders."""
    orders = t.counted(t.orders())
    totals = facts.order_financials(t.accepted_lines())
    joined = scenarios.attach_financials(orders, totals)
    return summaries.summarize_distinct(joined, t.scenarios(), ["ship_mode"])


# -- data quality -----------------------------------------------------------------


@query
def dq_row_checks(t: OrderTables) -> DataFrame:
    return quality.row_checks(t.raw_lines())


@query
def dq_line_accounting(t: OrderTables) -> DataFrame:
    """Every line of the source, accepted or left out by cause."""
    return t.line_accounting()


@query
def dq_contract_report(t: OrderTables) -> DataFrame:
    """Violations of the whole contract on the raw lines, in one pass over them."""
    return quality.report(t.raw_lines(), scenarios.days_of(t.scenarios(), "base"))


@query
def dq_null_counts(t: OrderTables) -> DataFrame:
    return quality.null_counts(t.raw_lines())


@query
def dq_duplicate_keys(t: OrderTables) -> DataFrame:
    return quality.duplicate_keys(t.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dq_duplicate_row_ids(t: OrderTables) -> DataFrame:
    """How many rows and how many distinct row ids there are, and how many repeat."""
    rows = t.numbered(t.items()).groupBy("row_id").agg(F.count(F.lit(1)).alias("copies"))
    return rows.agg(
        F.sum("copies").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_row_ids"),
        F.count_if(F.col("copies") > 1).alias("duplicated_row_ids"),
    )


@query
def dq_inconsistent_orders(t: OrderTables) -> DataFrame:
    return quality.inconsistent_groups(
        t.raw_lines(product=False), ["order_id"], schema.ORDER_FIELDS
    )


@query
def dq_order_fact_variants(t: OrderTables) -> DataFrame:
    """Orders whose lines give more than one order fact, over all fourteen fields."""
    lines = t.with_place(t.shipped_lines()).withColumnRenamed("line_ship_date", "ship_date")
    rated = facts.with_sla(lines.select("order_id", *schema.ORDER_FIELDS), t.scenarios())
    return quality.inconsistent_groups(rated, ["order_id"], schema.FACT_ORDERS[1:])


@query
def dq_expected_rows(t: OrderTables) -> DataFrame:
    """The row checks with the number of rows the contract expects."""
    return quality.row_checks(t.raw_lines(), config.EXPECTED_ROWS)


@query
def dq_unknown_modes(t: OrderTables) -> DataFrame:
    known = t.scenarios("base").select("ship_mode")
    return quality.unknown_values(t.modes(), "ship_mode", known)


@query
def dq_planted_modes(t: OrderTables) -> DataFrame:
    """The same report after one priority was renamed for some orders, which must show."""
    known = t.scenarios("base").select("ship_mode")
    low = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderkey") % 7 == 0)
    renamed = F.when(low, "6-NONE").otherwise(F.col("o_orderpriority"))
    planted = t.table("orders").withColumn("o_orderpriority", renamed)
    return quality.unknown_values(t.modes(planted), "ship_mode", known)


@query
def dq_dimension_conflicts(t: OrderTables) -> DataFrame:
    described = ["product_name", "category", "sub_category"]
    return quality.inconsistent_groups(t.sold_products(), ["product_id"], described)


@query
def dq_grain_reconciliation(t: OrderTables) -> DataFrame:
    """Counts that must agree between tables built in different ways."""
    return _grain_counts(t, t.accepted_lines())


@query
def dq_grain_missing_lines(t: OrderTables) -> DataFrame:
    """The same counts when the lines of one ship mode are missing, which must show."""
    return _grain_counts(t, t.accepted_lines().where("ship_mode <> 'Same Day'"))


def _grain_counts(t: OrderTables, accepted: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    lines = materialise(accepted.select("order_id", "sales", "profit"), "lines")
    orders = materialise(t.counted(t.orders()), "orders")
    totals = materialise(facts.order_financials(lines), "financials")
    detail = scenarios.classify(orders, t.scenarios()).select("scenario", "order_id")
    expected = orders.agg((one * len(set(r[1] for r in source.THRESHOLDS.rows()))).alias("n"))
    zero = orders.limit(0).agg(one)
    table = t.scenarios()
    return quality.compare_counts(
        {
            "orders_in_both_facts": (
                lines.agg(F.count_distinct("order_id")),
                orders.agg(F.count_distinct("order_id")),
            ),
            "order_id_unique": (orders.agg(one), orders.agg(F.count_distinct("order_id"))),
            "financials_per_order": (totals.agg(one), orders.agg(one)),
            "orders_without_financials": (
                quality.rows_without_match(orders, totals, ["order_id"]).agg(one),
                zero,
            ),
            "null_order_fields": (quality.null_key_count(orders, orders.columns), zero),
            "scenario_rows": (detail.agg(one), expected),
            "scenario_key_duplicates": (
                quality.duplicate_keys(detail, ["scenario", "order_id"]).agg(one),
                zero,
            ),
            "threshold_key_duplicates": (
                quality.duplicate_keys(table, ["scenario", "ship_mode"]).agg(one),
                zero,
            ),
        }
    )


# -- star schema ------------------------------------------------------------------


@query
def dim_date(t: OrderTables) -> DataFrame:
    return date_dimension(date_bounds(t.orders(), "order_date", "ship_date"))


@query
def dim_customer(t: OrderTables) -> DataFrame:
    return star.build_dimension(t.orders(place=True), "dim_customer")


@query
def dim_location(t: OrderTables) -> DataFrame:
    return star.build_dimension(t.orders(place=True), "dim_location")


@query
def dim_product(t: OrderTables) -> DataFrame:
    return star.build_dimension(t.sold_products(), "dim_product")


@query
def dim_ship_mode(t: OrderTables) -> DataFrame:
    return star.build_dimension(t.orders(), "dim_ship_mode")


@query
def fact_order_lines_star(t: OrderTables) -> DataFrame:
    """Keys are looked up at the grain they belong to, orders and parts.

    Lines then meet two tables that already carry the keys, whatever the number
    of dimensions, and no text is compared at line grain.
    """
    pairs = t.pairs()
    orders = materialise(t.orders(place=True, shipped=pairs), "orders")
    tables = {name: star.build_dimension(orders, name) for name in star.OF_ORDERS}
    tables["dim_product"] = star.build_dimension(t.sold_products(pairs), "dim_product")
    keyed = star.with_keys(star.with_dates(orders), tables, *star.OF_ORDERS).select(
        "order_id", "order_date", *[k for k in schema.STAR_KEYS if k != "product_key"]
    )
    products = star.with_keys(t.products(), tables, "dim_product")
    products = products.select("part_key", "product_key", "p_retailprice")
    return star.fact_columns(t.priced(t.accept(t.described(products), keyed)))


# -- diagnostics of the calibrated scenario -----------------------------------------


@query
def region_volume(t: OrderTables) -> DataFrame:
    return diagnostics.region_volume(t.calibrated(t.orders(place=True)), source.REGIONS)


@query
def overall_late_rate(t: OrderTables) -> DataFrame:
    return diagnostics.overall_rate(t.calibrated(t.orders()))


@query
def mode_year_trend(t: OrderTables) -> DataFrame:
    return diagnostics.mode_year_trend(t.calibrated(t.orders()))


@query
def subcategory_hotspots(t: OrderTables) -> DataFrame:
    pairs = t.pairs()
    return diagnostics.hotspots(t.sold(pairs), t.calibrated(t.orders(place=True, shipped=pairs)))


@query
def category_rates(t: OrderTables) -> DataFrame:
    pairs = t.pairs()
    return diagnostics.member_rates(t.sold(pairs), t.calibrated(t.orders(shipped=pairs)), "category")


@query
def subcategory_rates(t: OrderTables) -> DataFrame:
    pairs = t.pairs()
    return diagnostics.member_rates(
        t.sold(pairs), t.calibrated(t.orders(shipped=pairs)), "sub_category",
        source.MIN_SUBCATEGORY_ORDERS,
    )


@query
def subcategory_extremes(t: OrderTables) -> DataFrame:
    return diagnostics.both_ends(subcategory_rates(t), "sub_category", 5, 3)


@query
def state_rates(t: OrderTables) -> DataFrame:
    orders = t.calibrated(t.orders(place=True))
    return diagnostics.group_rates(orders, "state", source.MIN_STATE_ORDERS)


@query
def state_extremes(t: OrderTables) -> DataFrame:
    return diagnostics.both_ends(state_rates(t), "state", 2, 2)


@query
def year_rates(t: OrderTables) -> DataFrame:
    return diagnostics.year_rates(t.calibrated(t.orders()))


@query
def top_months(t: OrderTables) -> DataFrame:
    return diagnostics.top_months(t.calibrated(t.orders()))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles that depend on the order of summation, to nine digits for comparison."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query
def late_vs_ontime_financials(t: OrderTables) -> DataFrame:
    found = diagnostics.late_against_on_time(t.calibrated(t.order_facts()))
    return _rounded(found, "avg_weighted_discount", "avg_margin")


@query
def late_vs_ontime_by_mode(t: OrderTables) -> DataFrame:
    found = diagnostics.late_against_on_time(t.calibrated(t.order_facts()), "ship_mode")
    return _rounded(found, "avg_weighted_discount", "avg_margin")


@query
def late_correlations(t: OrderTables) -> DataFrame:
    found = diagnostics.late_correlations(t.calibrated(t.order_facts()))
    return _rounded(found, "correlation")


@query
def region_year_correlation(t: OrderTables) -> DataFrame:
    found = diagnostics.region_year_correlation(t.calibrated(t.orders(place=True)))
    return _rounded(found, "correlation")


@query
def within_region_correlation(t: OrderTables) -> DataFrame:
    found = diagnostics.within_region_correlation(t.calibrated(t.orders(place=True)))
    return _rounded(found, "correlation")


# -- reconciliation -----------------------------------------------------------------


def _from_calls(t: OrderTables) -> dict[str, DataFrame]:
    """The four summaries from DataFrame calls; the orders are read once."""
    dims = [d for family in summaries.FAMILIES.values() for d in family]
    orders = _with_month(t, t.order_facts(place=True))
    folded = materialise(summaries.cells(orders, dims), "cells")
    return {
        name: summaries.summarize_cells(folded, t.scenarios(), family)
        for name, family in summaries.FAMILIES.items()
    }


def _from_sql(
    t: OrderTables, lines: DataFrame | None = None, names: Iterable[str] = tuple(summaries.FAMILIES)
) -> dict[str, DataFrame]:
    """The same summaries from order lines, by SQL alone."""
    lines = lines if lines is not None else t.canonical_lines()
    return sql_path.summaries(lines, t.scenarios(), t.calendar(), names)


def _two_paths(t: OrderTables) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    return _from_calls(t), _from_sql(t)


def _compare(name: str, left: DataFrame, right: DataFrame, **options) -> DataFrame:
    keys = ["scenario", *summaries.FAMILIES[name]]
    if name == "by_month":
        # One side keys months by date, the other by text.
        left = left.withColumn("order_month", F.date_format("order_month", "yyyy-MM"))
    return reconcile.reconcile(left, right, keys, **options)


@query
def reconcile_clean(t: OrderTables) -> DataFrame:
    calls, plain = _two_paths(t)
    return reconcile.failures({n: _compare(n, calls[n], plain[n]) for n in calls})


@query
def reconcile_exported(t: OrderTables) -> DataFrame:
    """Summaries written as text and loaded back with their types, against SQL."""
    calls, plain = _two_paths(t)
    loaded = {}
    for name, summary in calls.items():
        path = fresh_path(t.spark, f"summary-{name}")
        files.write_delimited(summary, path)
        loaded[name] = files.read_delimited_table(t.spark, path, summary.schema)
    return reconcile.failures({n: _compare(n, loaded[n], plain[n]) for n in calls})


@query
def reconcile_perturbed(t: OrderTables) -> DataFrame:
    """The same comparison after planting differences that must be found."""
    calls, plain = _two_paths(t)
    strict, month = F.col("scenario") == "strict", F.col("order_month") < "1997"
    plain["overall"] = plain["overall"].withColumn(
        "total_sales",
        F.when(strict, F.col("total_sales") + Decimal("0.0001")).otherwise(F.col("total_sales")),
    )
    plain["by_ship_mode"] = plain["by_ship_mode"].withColumn(
        "late_orders", F.col("late_orders") + F.when(F.col("ship_mode") == "Same Day", 1).otherwise(0)
    )
    plain["by_region"] = plain["by_region"].where(F.col("region") != "ASIA")
    nudge = F.when(month, 1e-13).otherwise(1e-9)
    plain["by_month"] = plain["by_month"].withColumn("late_order_rate", F.col("late_order_rate") + nudge)
    return reconcile.failures({n: _compare(n, calls[n], plain[n]) for n in calls})


@query
def reconcile_duplicated_line(t: OrderTables) -> DataFrame:
    """The SQL side counts one line twice, which every family must report."""
    lines = materialise(t.canonical_lines().select("row_id", *sql_path.COLUMNS), "lines")
    first = lines.agg(F.min("row_id").alias("row_id"))
    twice = lines.unionByName(lines.join(F.broadcast(first), "row_id"))
    calls, plain = _from_calls(t), _from_sql(t, twice)
    return reconcile.failures({n: _compare(n, calls[n], plain[n]) for n in calls})


@query
def reconcile_overall(t: OrderTables) -> DataFrame:
    calls = summaries.summarize_orders(t.counted(t.order_facts()), t.scenarios())
    plain = _from_sql(t, names=["overall"])["overall"]
    return _compare("overall", calls, plain, show=["late_orders", "late_order_rate"])


# -- files ----------------------------------------------------------------------------


@query
def csv_roundtrip(t: OrderTables) -> DataFrame:
    path = fresh_path(t.spark, "source-csv")
    files.write_source(t.canonical_lines(), path, compression=TEXT_CODEC)
    return files.read_source(t.spark, path)


@query
def csv_null_tokens(t: OrderTables) -> DataFrame:
    """Nulls per column after texts that read as null were written into three columns."""
    asia, low = F.col("region") == "ASIA", F.col("quantity") < 10
    planted = t.canonical_lines().withColumns(
        {
            "city": F.when(asia, "NA").otherwise(F.col("city")),
            "segment": F.when(low, "n/a").otherwise(F.col("segment")),
            "category": F.when(asia & low, "Na").otherwise("None"),
        }
    )
    path = fresh_path(t.spark, "source-csv")
    files.write_source(planted, path, compression=TEXT_CODEC)
    return quality.null_counts(files.read_source(t.spark, path))


@query
def load_fact_orders(t: OrderTables) -> DataFrame:
    """The order fact written as text and loaded with its types."""
    return _reloaded(t, "fact-orders", fact_orders(t))


@query
def load_order_lines(t: OrderTables) -> DataFrame:
    """The line fact written as text and loaded with its types."""
    return _reloaded(t, "order-lines", t.canonical_lines())


def _reloaded(t: OrderTables, name: str, table: DataFrame) -> DataFrame:
    path = fresh_path(t.spark, name)
    files.write_delimited(table, path, TEXT_CODEC)
    return files.read_delimited_table(t.spark, path, table.schema)


@query
def stored_scenario(t: OrderTables) -> DataFrame:
    """One scenario read back from the stored detail, which reads one folder."""
    path = fresh_path(t.spark, "scenario-orders")
    detail = scenario_orders(t)
    files.write_table(detail, path, ("scenario",))
    stored = files.read_table(t.spark, path, detail.schema)
    return stored.where("scenario = 'strict'").select(*detail.columns)


def _source_file(t: OrderTables) -> str:
    path = fresh_path(t.spark, "source-csv")
    files.write_source(t.canonical_lines(), path, compression=TEXT_CODEC)
    return path


def _pipeline(t: OrderTables) -> dict[str, DataFrame]:
    output = fresh_path(t.spark, "pipeline")
    return pipeline.run(t.spark, _source_file(t), output, None, source.THRESHOLDS)


@query
def pipeline_by_month(t: OrderTables) -> DataFrame:
    """From a delimited file through validation, facts, star and scenarios."""
    return _pipeline(t)["by_month"]


@query
def pipeline_star_fact(t: OrderTables) -> DataFrame:
    """The line fact with surrogate keys that the same run wrote."""
    return _pipeline(t)["fact_order_lines_star"]


@query
def pipeline_analyze_by_region(t: OrderTables) -> DataFrame:
    """A summary from the public transform and analyze calls."""
    lines, orders = pipeline.transform(t.spark, _source_file(t), None, source.THRESHOLDS)
    return pipeline.analyze(orders, lines, source.THRESHOLDS)["by_region"]
