"""Column names, types and groups of the order-line source."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
RATE = T.DecimalType(9, 6)
# Totals keep Spark's widened precision: at 10^12 lines a total no longer fits
# the 14 integer digits of MONEY.
ORDER_TOTAL = T.DecimalType(28, 4)
GRAND_TOTAL = T.DecimalType(38, 4)

# Source column name -> our name, in file order.
SOURCE_NAMES = {
    "Row ID": "row_id",
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Ship Date": "ship_date",
    "Ship Mode": "ship_mode",
    "Customer ID": "customer_id",
    "Customer Name": "customer_name",
    "Segment": "segment",
    "Country": "country",
    "City": "city",
    "State": "state",
    "Postal Code": "postal_code",
    "Region": "region",
    "Product ID": "product_id",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Product Name": "product_name",
    "Sales": "sales",
    "Quantity": "quantity",
    "Discount": "discount",
    "Profit": "profit",
}

# Columns that are not text.
SOURCE_TYPES = {
    "order_date": T.DateType(),
    "ship_date": T.DateType(),
    "sales": MONEY,
    "quantity": T.IntegerType(),
    "discount": RATE,
    "profit": MONEY,
}

LINE_COLUMNS = list(SOURCE_NAMES.values())

LINES = T.StructType(
    [T.StructField(c, SOURCE_TYPES.get(c, T.StringType())) for c in LINE_COLUMNS]
)

LOCATION = ["country", "city", "state", "postal_code", "region"]
PRODUCT = ["product_id", "product_name", "category", "sub_category"]
CUSTOMER_ATTRIBUTES = ["customer_name", "segment"]

# Constant on every line of one order.
ORDER_FIELDS = ["order_date", "ship_date", "ship_mode", "customer_id", *LOCATION]
# Derived at order grain.
SLA_FIELDS = [
    "calendar_days_to_ship",
    "business_days_to_ship",
    "sla_days",
    "sla_variance",
    "is_late",
]
FACT_ORDERS = ["order_id", *ORDER_FIELDS, *SLA_FIELDS]

STAR_KEYS = [
    "order_date_key",
    "ship_date_key",
    "customer_key",
    "location_key",
    "product_key",
    "ship_mode_key",
]
STAR_FACT = ["row_id", "order_id", *STAR_KEYS, "sales", "quantity", "discount", "profit"]

SUMMARY_COUNTS = ["orders", "successful_orders", "late_orders"]
SUMMARY_MONEY = ["total_sales", "late_order_sales", "total_profit", "late_order_profit"]
SUMMARY_RATES = ["success_rate", "late_order_rate"]
SUMMARY_MEASURES = [*SUMMARY_COUNTS, *SUMMARY_MONEY, *SUMMARY_RATES]
