"""Star schema: dimensions with dense keys and the order-line fact."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import schema
from harborline.functions.calendar import date_bounds, date_dimension, date_key
from harborline.functions.columns import guarded
from harborline.operators import quality
from harborline.operators.keys import dense_key
from harborline.session import materialise

# Dimension -> (surrogate key, natural columns, attributes).
DIMENSIONS = {
    "dim_customer": ("customer_key", ["customer_id"], schema.CUSTOMER_ATTRIBUTES),
    "dim_location": ("location_key", schema.LOCATION, []),
    "dim_product": ("product_key", schema.PRODUCT, []),
    "dim_ship_mode": ("ship_mode_key", ["ship_mode"], []),
}

# Dimensions whose keys an order carries, and those that a line carries by itself.
OF_ORDERS = ["dim_customer", "dim_location", "dim_ship_mode"]
OF_PRODUCTS = ["dim_product"]


def natural_columns(names: Sequence[str]) -> list[str]:
    return [column for name in names for column in DIMENSIONS[name][1]]


def build_dimension(lines: DataFrame, name: str) -> DataFrame:
    """Distinct natural keys with attributes, numbered in natural order."""
    key, natural, attributes = DIMENSIONS[name]
    dimension = dense_key(lines.select(*natural, *attributes).distinct(), natural, key)
    if attributes:
        # Checked on the written dimension, not on the lines again.
        quality.require_unique(dimension, natural, f"{name} has conflicting attributes, it")
    return dimension


def build_dates(lines: DataFrame) -> DataFrame:
    """Every day from the first to the last order or ship date."""
    return date_dimension(date_bounds(lines, "order_date", "ship_date"))


def _with_key(fact: DataFrame, dimension: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Left join on a null-safe composite key, keeping only the surrogate."""
    names = {c: f"_{key}_{c}" for c in natural}
    side = dimension.select(*[F.col(c).alias(a) for c, a in names.items()], key)
    condition = F.lit(True)
    for column, alias in names.items():
        condition = condition & F.col(column).eqNullSafe(F.col(alias))
    return fact.join(side, condition, "left").drop(*names.values())


def with_dates(df: DataFrame) -> DataFrame:
    """Add the integer keys of the order and the ship date, which follow from the dates;
    the date dimension holds every day between them."""
    for role in ("order_date", "ship_date"):
        df = df.withColumn(f"{role}_key", date_key(role))
    return df


def with_keys(df: DataFrame, tables: dict[str, DataFrame], *names: str) -> DataFrame:
    """Add the surrogate keys of the named dimensions."""
    for name in names:
        key, natural, _ = DIMENSIONS[name]
        df = _with_key(df, tables[name], natural, key)
    return df


def fact_columns(df: DataFrame) -> DataFrame:
    """The fact's columns; a key that was not found fails the job."""
    found = F.lit(True)
    for key in schema.STAR_KEYS:
        found = found & F.col(key).isNotNull()
    missing = [F.when(F.col(key).isNull(), key) for key in schema.STAR_KEYS]
    message = F.concat(
        F.lit("No dimension row for "), F.concat_ws(", ", *missing), F.lit(" of line "), "row_id"
    )
    return guarded(df, found, message).select(*schema.STAR_FACT)


# Tries with codes of 64 bits, which tell up to some billion tuples apart, before 128 bits.
NARROW_SEEDS = 3


def code(columns: Sequence[str], seed: int) -> Column:
    """64 or, from ``NARROW_SEEDS`` on, 128 bits of a tuple in which nulls are values."""
    absent = [F.col(c).isNull() for c in columns]
    halves = [F.xxhash64(F.lit(2 * seed + half), *absent, *[F.col(c) for c in columns]) for half in (0, 1)]
    if seed < NARROW_SEEDS:
        return halves[0]
    return F.struct(halves[0].alias("high"), halves[1].alias("low"))


def dictionary(
    tuples: DataFrame, tables: dict[str, DataFrame], names: Sequence[str]
) -> tuple[DataFrame, int]:
    """(code, surrogate keys) of every tuple of natural columns, and the codes' seed.

    ``tuples`` holds all tuples that occur. Where two of them share a code, the next
    seed is taken, so within this table a code stands for one tuple and no other.
    """
    natural = natural_columns(names)
    distinct = tuples.select(*natural).distinct()
    for seed in count():
        coded = distinct.withColumn("code", code(natural, seed))
        if quality.duplicate_keys(coded, ["code"]).isEmpty():
            break
    keys = [DIMENSIONS[name][0] for name in names]
    return with_keys(coded, tables, *names).select("code", *keys), seed


def fact_from(
    lines: DataFrame, tables: dict[str, DataFrame], tuples: dict[tuple[str, ...], DataFrame]
) -> DataFrame:
    """Order lines with surrogate keys, looked up once per different tuple.

    ``tuples`` maps groups of dimensions to the tuples that occur. Text is compared and
    joined among those; the lines carry their codes through the exchanges. Groups whose
    keys are few come first, so that lines meet an exchange with keys instead of codes.
    """
    sides = [(names, *dictionary(table, tables, names)) for names, table in tuples.items()]
    coded = with_dates(lines).select(
        *[c for c in schema.STAR_FACT if c not in schema.STAR_KEYS],
        "order_date_key",
        "ship_date_key",
        *[code(natural_columns(names), seed).alias(f"_code_{i}") for i, (names, _, seed) in enumerate(sides)],
    )
    for i, (_, side, _) in enumerate(sides):
        coded = coded.join(side.withColumnRenamed("code", f"_code_{i}"), f"_code_{i}", "left")
    return fact_columns(coded)


def build_fact(lines: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Order lines with surrogate keys."""
    return fact_from(lines, tables, {tuple(OF_ORDERS): lines, tuple(OF_PRODUCTS): lines})


def build(
    lines: DataFrame, store: Callable[[str, DataFrame], DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Five dimensions and the fact.

    ``lines`` is read six times, so pass a stored table: for the dates, for the
    different tuples of each dimension, and for the fact. Combinations of dimensions
    are not built: they are many times the members. ``store`` writes a table and returns the written one; the
    fact then reads the stored dimensions.
    """
    store = store or (lambda name, table: table)
    # Places and modes are few by nature, customers and products are not.
    tuples = {}
    for name in ("dim_location", "dim_ship_mode", "dim_customer", "dim_product"):
        _, natural, attributes = DIMENSIONS[name]
        tuples[(name,)] = materialise(lines.select(*natural, *attributes).distinct(), f"{name}-tuples")
    tables = {"dim_date": store("dim_date", build_dates(lines))}
    for names, table in tuples.items():
        for name in names:
            tables[name] = store(name, build_dimension(table, name))
    fact = store("fact_order_lines_star", fact_from(lines, tables, tuples))
    return {**tables, "fact_order_lines_star": fact}
