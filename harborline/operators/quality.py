"""Data-quality checks: each returns offenders or counts, ``validate`` raises."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline import config, schema

# How many offenders an error message names unless told otherwise; None names them all.
NAMED_IN_MESSAGE = 20


class QualityError(ValueError):
    """The source breaks the data contract."""


def missing_columns(df: DataFrame, required: Iterable[str] = schema.LINE_COLUMNS) -> list[str]:
    """Required columns that are absent; reads no data."""
    return sorted(set(required) - set(df.columns))


def any_null(columns: Iterable[str]) -> Column:
    test = F.lit(False)
    for column in columns:
        test = test | F.col(column).isNull()
    return test


def row_conditions(columns: Sequence[str]) -> dict[str, Column]:
    """Violations visible on a single row, in reporting order."""
    return {
        "row_id_null": F.col("row_id").isNull(),
        "null_values": any_null(columns),
        "ship_before_order": F.col("ship_date") < F.col("order_date"),
        "negative_sales": F.col("sales") < 0,
        "quantity_not_positive": F.col("quantity") <= 0,
        "discount_outside_0_1": ~F.col("discount").between(0, 1),
    }


def row_checks(df: DataFrame, expected_rows: int | None = None) -> DataFrame:
    """(check_name, violations) of all row-level checks and the row count, one pass."""
    rows = F.count(F.lit(1))
    counts = {"row_count": rows}
    if expected_rows is not None:
        counts["row_count_difference"] = F.abs(rows - F.lit(expected_rows))
    for name, condition in row_conditions(df.columns).items():
        counts[name] = F.count_if(condition)
    return _as_rows(df.agg(*[c.alias(name) for name, c in counts.items()]), "check_name")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, violations) for every column, one pass."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _as_rows(nulls, "column_name")


def _as_rows(one_row: DataFrame, label: str) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias(label), F.col(c).alias("violations")) for c in one_row.columns
    ]
    return one_row.select(F.inline(F.array(*pairs)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def inconsistent_groups(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose fields take more than one combination, null being a value.

    The distinct step is combined before its exchange, so a key that holds a
    large share of the rows arrives as its few combinations only.
    """
    variants = df.select(*keys, *fields).distinct()
    return variants.groupBy(*keys).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def unknown_values(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Values of ``column`` absent from ``known``, with their row counts."""
    used = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    return used.join(known.select(column).distinct(), column, "left_anti")


def rows_without_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` that find no partner in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def null_key_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of rows holding a null in the given columns."""
    return df.agg(F.count_if(any_null(columns)).alias("violations"))


def require_unique(
    df: DataFrame, keys: Sequence[str], label: str, named: int | None = NAMED_IN_MESSAGE
) -> DataFrame:
    """``df`` itself, after checking that the keys identify its rows."""
    offenders = duplicate_keys(df, keys)
    _raise_if_any(offenders, keys, f"{label} is not unique on {', '.join(keys)}", named)
    return df


def require_consistent(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str], named: int | None = NAMED_IN_MESSAGE
) -> DataFrame:
    """``df`` itself, after checking that the fields are constant per key."""
    offenders = inconsistent_groups(df, keys, fields)
    _raise_if_any(offenders, keys, f"Fields are inconsistent within {', '.join(keys)}", named)
    return df


def _fingerprint(fields: Sequence[str], seed: int) -> Column:
    """64 bits of the combination of fields, null being a value."""
    return F.xxhash64(F.lit(seed), *[F.col(f).isNull() for f in fields], *[F.col(f) for f in fields])


def report(
    df: DataFrame, modes: DataFrame, expected_rows: int | None = None
) -> DataFrame:
    """(check_name, violations) of the whole contract, from one pass over the rows.

    Each row goes into one aggregation under four tags: with its row-level violations,
    and with its row id, its mode, and its order and two fingerprints of the order's
    fields. Tags and keys are combined before the one exchange, which carries no other
    column. An order is inconsistent when the least and greatest of a fingerprint differ.
    """
    conditions = row_conditions(df.columns)
    flags = {f"_flag_{i}": condition for i, condition in enumerate(conditions.values())}
    narrow = df.select(
        F.col("row_id").cast("string").alias("_row"),
        F.col("ship_mode").cast("string").alias("_mode"),
        F.col("order_id").cast("string").alias("_order"),
        _fingerprint(schema.ORDER_FIELDS, 0).alias("_a"),
        _fingerprint(schema.ORDER_FIELDS, 1).alias("_b"),
        *[condition.alias(name) for name, condition in flags.items()],
    )

    def tagged(tag: str, key: Column, rows: bool = False, order: bool = False) -> Column:
        return F.struct(
            F.lit(tag).alias("tag"), key.cast("string").alias("key"),
            *[(F.col(c) if order else F.lit(None).cast("bigint")).alias(c) for c in ("_a", "_b")],
            *[(F.col(c) if rows else F.lit(None).cast("boolean")).alias(c) for c in flags],
        )

    tags = F.array(
        tagged("row", F.lit(None), rows=True),
        tagged("row_id", F.col("_row")),
        tagged("mode", F.col("_mode")),
        tagged("order", F.col("_order"), order=True),
    )
    folded = narrow.select(F.inline(tags)).groupBy("tag", "key").agg(
        F.count(F.lit(1)).alias("copies"),
        ((F.min("_a") != F.max("_a")) | (F.min("_b") != F.max("_b"))).alias("differs"),
        *[F.count_if(c).alias(c) for c in flags],
    )
    known = modes.select(F.col("ship_mode").alias("key"), F.lit("mode").alias("tag"), F.lit(True).alias("known"))
    # The known modes are a handful of rows.
    judged = folded.join(F.broadcast(known.distinct()), ["tag", "key"], "left")
    rows = F.coalesce(F.sum(F.when(F.col("tag") == "row", F.col("copies"))), F.lit(0))
    counts = {"row_count": rows}
    if expected_rows is not None:
        counts["row_count_difference"] = F.abs(rows - F.lit(expected_rows))
    for name, flag in zip(conditions, flags):
        counts[name] = F.coalesce(F.sum(F.when(F.col("tag") == "row", F.col(flag))), F.lit(0))
    counts["row_id_duplicated"] = F.count_if((F.col("tag") == "row_id") & (F.col("copies") > 1))
    counts["unknown_ship_modes"] = F.count_if((F.col("tag") == "mode") & F.col("known").isNull())
    counts["inconsistent_orders"] = F.count_if((F.col("tag") == "order") & F.col("differs"))
    return _as_rows(judged.agg(*[c.alias(name) for name, c in counts.items()]), "check_name")


# The order in which violations are raised.
CONTRACT = [
    "row_count_difference",
    "row_id_null",
    "row_id_duplicated",
    "null_values",
    "ship_before_order",
    "negative_sales",
    "quantity_not_positive",
    "discount_outside_0_1",
    "unknown_ship_modes",
    "inconsistent_orders",
]


def validate(
    df: DataFrame,
    modes: DataFrame,
    expected_rows: int | None = config.EXPECTED_ROWS,
    named: int | None = NAMED_IN_MESSAGE,
) -> None:
    """Raise ``QualityError`` for the first violation in the contract's order.

    The message names up to ``named`` offenders, or all of them (None), which then have
    to fit the driver."""
    absent = missing_columns(df)
    if absent:
        raise QualityError(f"Missing columns: {', '.join(absent)}")
    found = {
        row.check_name: row.violations for row in report(df, modes, expected_rows).collect()
    }
    failed = next((name for name in CONTRACT if found.get(name)), None)
    if failed == "row_count_difference":
        raise QualityError(f"Expected {expected_rows} rows, found {found['row_count']}")
    if failed == "row_id_duplicated":
        require_unique(df, ["row_id"], "Source", named)
    if failed == "unknown_ship_modes":
        _raise_if_any(unknown_values(df, "ship_mode", modes), ["ship_mode"], "Unknown ship modes", named)
    if failed == "inconsistent_orders":
        require_consistent(df, ["order_id"], schema.ORDER_FIELDS, named)
    if failed:
        raise QualityError(f"{failed}: {found[failed]} rows")


def compare_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(check_name, left_count, right_count, is_equal) from pairs of one-row counts."""
    sides = None
    for name, (left, right) in pairs.items():
        for side, counted in (("left", left), ("right", right)):
            row = counted.toDF("n").select(
                F.lit(name).alias("check_name"), F.lit(side).alias("side"), "n"
            )
            sides = row if sides is None else sides.unionByName(row)

    def on(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("n")))

    return (
        sides.groupBy("check_name")
        .agg(on("left").alias("left_count"), on("right").alias("right_count"))
        .withColumn("is_equal", F.col("left_count") == F.col("right_count"))
    )


def _raise_if_any(
    offenders: DataFrame, keys: Sequence[str], message: str, named: int | None = NAMED_IN_MESSAGE
) -> None:
    chosen = offenders.select(*keys)
    found = (chosen if named is None else chosen.limit(named + 1)).collect()
    if not found:
        return
    values = ", ".join(sorted(" / ".join(map(str, row)) for row in found[:named]))
    more = " and more" if named is not None and len(found) > named else ""
    raise QualityError(f"{message}: {values}{more}")
