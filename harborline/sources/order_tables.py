"""Canonical order lines and orders from the normalised order tables.

The tables ``lineitem orders customer nation region part`` play the source:
priorities stand for ship modes, nations for places, and an order counts as
shipped with its last accepted line. A line is accepted when it does not ship
before its order date. Descriptive tables are joined on their keys from the
left, so a missing partner shows up as a null instead of losing rows.

Join order matters for skew: lines meet orders while both come straight from
their own exchange, the form in which an oversized order is split at run time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline import config, schema
from harborline.functions.calendar import business_calendar, with_business_days
from harborline.operators import facts, scenarios
from harborline.session import materialise

# Priority -> ship mode. Any other priority has no mode: classification then fails.
MODES = {"1-URGENT": "Same Day", "2-HIGH": "First Class", "3-MEDIUM": "Second Class"}
STANDARD = {"4-NOT SPECIFIED": "Standard Class", "5-LOW": "Standard Class"}
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

# Lags run to years here, so the limits are wider than in the source data.
THRESHOLDS = config.Thresholds(
    base={"Same Day": 0, "First Class": 250, "Second Class": 500, "Standard Class": 1000},
    calibrated={"Same Day": 0, "First Class": 600, "Second Class": 700, "Standard Class": 800},
    step=100,
)
# The calendar of tables without any date.
NO_DATES = dt.date(1990, 1, 1)

MIN_SUBCATEGORY_ORDERS = 1100
MIN_STATE_ORDERS = 450

# Columns in use, declared so that opening a table reads no footer.
TABLES = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
}


def _mode() -> Column:
    mode = F.lit(None).cast("string")
    for priority, name in {**MODES, **STANDARD}.items():
        mode = F.when(F.col("o_orderpriority") == priority, name).otherwise(mode)
    return mode


class OrderTables:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._bounds: tuple[dt.date, dt.date] | None = None

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    # -- data held as settings ------------------------------------------------

    def calendar(self) -> DataFrame:
        """The calendar table of the SQL path; calls count without one."""
        first, last = self.bounds()
        return business_calendar(self.spark, first, last, config.federal_holidays(first, last))

    def bounds(self) -> tuple[dt.date, dt.date]:
        """First and last date of orders and lines, read once per object."""
        if self._bounds is None:
            found = []
            for name, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
                date = F.col(column).cast("date")
                found += self.table(name).agg(F.min(date), F.max(date)).first()
            dates = [date for date in found if date is not None] or [NO_DATES]
            self._bounds = min(dates), max(dates)
        return self._bounds

    def scenarios(self, *names: str) -> DataFrame:
        table = scenarios.scenario_table(self.spark, THRESHOLDS)
        return table.where(F.col("scenario").isin(*names)) if names else table

    # -- building blocks ------------------------------------------------------

    def modes(self, orders: DataFrame | None = None) -> DataFrame:
        """The ship mode of every order; a priority without one stays as it is."""
        orders = orders if orders is not None else self.table("orders")
        return orders.select(F.coalesce(_mode(), "o_orderpriority").alias("ship_mode"))

    def _headers(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").cast("date").alias("order_date"),
            _mode().alias("ship_mode"),
            F.col("o_custkey").alias("customer_id"),
        )

    def items(self) -> DataFrame:
        """The lines alone, as narrow as they are stored."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("part_key"),
            F.col("l_suppkey").alias("supplier_key"),
            F.col("l_shipdate").cast("date").alias("line_ship_date"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
        )

    def numbered(self, lines: DataFrame) -> DataFrame:
        """Add ``row_id``; these five columns identify a line without a window."""
        parts = ["order_id", "line_number", "part_key", "supplier_key"]
        return lines.withColumn(
            "row_id", F.concat_ws("-", *parts, F.unix_date("line_ship_date"))
        )

    def with_place(self, orders: DataFrame) -> DataFrame:
        """Add customer and location columns to rows with ``customer_id``."""
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        places = self.table("customer").join(
            nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
        customers = places.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
            F.lit("ALL").alias("country"),
            F.col("n_name").alias("city"),
            F.col("n_name").alias("state"),
            F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("postal_code"),
            F.col("r_name").alias("region"),
        )
        return orders.join(customers, "customer_id", "left")

    def products(self) -> DataFrame:
        """Product columns and unit cost per part."""
        return self.table("part").select(
            F.col("p_partkey").alias("part_key"),
            F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            "p_retailprice",
        )

    def described(self, products: DataFrame | None = None) -> DataFrame:
        """The lines with their product, joined before they meet the orders.

        What follows on ``order_id`` (acceptance, totals, distinct members) then
        shares the one exchange of the order join.
        """
        products = products if products is not None else self.products()
        return self.items().join(products, "part_key", "left")

    def priced(self, lines: DataFrame) -> DataFrame:
        """Add row id and money to described lines, once they were filtered."""
        discount = F.col("l_discount").cast(schema.RATE)
        price = F.col("l_extendedprice").cast(schema.MONEY)
        sales = (price * (1 - discount)).cast(schema.MONEY)
        cost = F.col("l_quantity").cast("int") * F.col("p_retailprice").cast(schema.MONEY)
        return self.numbered(lines).withColumns(
            {
                "quantity": F.col("l_quantity").cast("int"),
                "discount": discount,
                "sales": sales,
                "profit": (sales - cost).cast(schema.MONEY),
            }
        )

    # -- line grain -----------------------------------------------------------

    @staticmethod
    def accept(lines: DataFrame, orders: DataFrame) -> DataFrame:
        """Lines of the given orders that do not ship before the order date."""
        return lines.join(orders, "order_id").where("line_ship_date >= order_date")

    def line_accounting(self) -> DataFrame:
        """How many lines are accepted or left out, by the first cause that holds."""
        lines = self.items().join(
            self._headers().withColumn("ordered", F.lit(True)), "order_id", "left"
        )
        outcome = (
            F.when(F.col("ordered").isNull(), "order missing")
            .when(F.col("order_date").isNull(), "order date missing")
            .when(F.col("line_ship_date").isNull(), "ship date missing")
            .when(F.col("line_ship_date") < F.col("order_date"), "shipped before order")
            .otherwise("accepted")
        )
        counted = lines.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("line_count"))
        total = self.table("lineitem").agg(F.count(F.lit(1)).alias("line_count"))
        return counted.unionByName(total.select(F.lit("all lines").alias("outcome"), "line_count"))

    def raw_lines(self, product: bool = True) -> DataFrame:
        """Every line with its own ship date, unchecked, in the source layout."""
        lines = self.described() if product else self.items()
        full = lines.join(self.with_place(self._headers()), "order_id", "left")
        full = self.priced(full) if product else self.numbered(full)
        columns = schema.LINE_COLUMNS if product else ["row_id", "order_id", *schema.ORDER_FIELDS]
        return full.withColumnRenamed("line_ship_date", "ship_date").select(*columns)

    def shipped_lines(self) -> DataFrame:
        """Accepted lines with their order header and ``line_ship_date``."""
        return self.accept(self.items(), self._headers())

    def accepted_lines(self) -> DataFrame:
        """The same lines with product columns and money."""
        return self.priced(self.accept(self.described(), self._headers()))

    def pairs(self) -> DataFrame:
        """(order_id, part_key, ship_date): the last shipment of each part of an order.

        One pass over the lines, stored narrow. The order's last shipment and the pairs
        with an accepted line follow from it: a pair has one when its last line is
        accepted, as acceptance only asks for a late enough date.
        """
        last = F.max("line_ship_date").alias("ship_date")
        return materialise(self.items().groupBy("order_id", "part_key").agg(last), "pairs")

    def sold_parts(self, pairs: DataFrame | None = None) -> DataFrame:
        """Distinct (order, part) pairs of the accepted lines, before any product text."""
        if pairs is None:
            return self.shipped_lines().select("order_id", "part_key").distinct()
        lines = pairs.withColumnRenamed("ship_date", "line_ship_date")
        return self.accept(lines, self._headers()).select("order_id", "part_key")

    def sold(self, pairs: DataFrame | None = None) -> DataFrame:
        """The same pairs with the product columns of the part."""
        return self.sold_parts(pairs).join(self.products(), "part_key", "left")

    def sold_products(self, pairs: DataFrame | None = None) -> DataFrame:
        """Product columns of every part with an accepted line."""
        parts = self.sold_parts(pairs) if pairs is not None else self.shipped_lines()
        return parts.select("part_key").distinct().join(self.products(), "part_key", "left")

    def canonical_lines(self, product: bool = True) -> DataFrame:
        """Accepted lines in the source layout; ``ship_date`` is the order's.

        The orders are stored first: an aggregate that is already partitioned by
        order would meet the lines without an exchange of its own, and an
        oversized order could then not be split. Lines meet their orders as narrow as
        they are stored, and only accepted ones then their product's text.
        """
        orders = materialise(self.orders(place=True), "orders")
        if not product:
            lines = self.numbered(self.accept(self.items(), orders))
            return lines.select("row_id", "order_id", *schema.ORDER_FIELDS)
        lines = self.accept(self.items(), orders).join(self.products(), "part_key", "left")
        return self.priced(lines).select(*schema.LINE_COLUMNS)

    # -- order grain ----------------------------------------------------------

    def orders(self, place: bool = False, shipped: DataFrame | None = None) -> DataFrame:
        """Orders with at least one accepted line, without touching money.

        The last ship date over all lines is the last accepted one whenever any
        line is accepted, so lines are folded before they meet the orders. ``shipped``
        are the stored pairs, where lines were folded to these already.
        """
        lines = shipped if shipped is not None else self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("date").alias("ship_date")
        )
        completed = lines.groupBy("order_id").agg(F.max("ship_date").alias("ship_date"))
        orders = self._headers().join(completed, "order_id")
        orders = orders.where(F.col("ship_date") >= F.col("order_date"))
        return self.with_place(orders) if place else orders

    def order_facts(self, place: bool = False) -> DataFrame:
        """The same orders with their totals, from one pass over the lines."""
        orders = facts.order_facts(
            self.accepted_lines(), ["order_date", "ship_mode", "customer_id"], "line_ship_date"
        )
        return self.with_place(orders) if place else orders

    def counted(self, orders: DataFrame) -> DataFrame:
        """Orders with ``business_days_to_ship``."""
        return with_business_days(orders)

    def calibrated(self, orders: DataFrame) -> DataFrame:
        """Orders classified under the calibrated scenario."""
        return scenarios.classify(self.counted(orders), self.scenarios("calibrated"))
