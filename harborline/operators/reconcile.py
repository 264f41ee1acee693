"""Tolerant comparison of two result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborline import schema

# Largest accepted difference (exclusive) for money and for rates.
MONEY_TOLERANCE = 1e-7
RATE_TOLERANCE = 1e-12

SUMMARY_TOLERANCES = {
    **dict.fromkeys(schema.SUMMARY_MONEY, MONEY_TOLERANCE),
    **dict.fromkeys(schema.SUMMARY_RATES, RATE_TOLERANCE),
}


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    exact: Sequence[str] = schema.SUMMARY_COUNTS,
    tolerances: dict[str, float] = SUMMARY_TOLERANCES,
    show: Sequence[str] = (),
) -> DataFrame:
    """Keys of both tables with ``matches``; a row on one side only is a mismatch.

    ``show`` names measures to place side by side as ``left_*`` and ``right_*``.
    """
    measures = list(dict.fromkeys([*exact, *tolerances, *show]))

    def side(df: DataFrame, label: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{label}_{c}") for c in measures])

    matches = F.lit(True)
    for column in exact:
        matches = matches & (F.col(f"left_{column}") == F.col(f"right_{column}"))
    for column, limit in tolerances.items():
        # Only the size of the difference is compared as a double: widening a
        # 38-digit decimal to the limit's scale would round the limit away.
        kind = _exact_type(left, right, column)
        gap = F.col(f"left_{column}").cast(kind) - F.col(f"right_{column}").cast(kind)
        matches = matches & (F.abs(gap).cast("double") < F.lit(float(limit)))
    shown = [f"{label}_{c}" for c in show for label in ("left", "right")]
    return (
        side(left, "left")
        .join(side(right, "right"), list(keys), "full")
        .select(*keys, F.coalesce(matches, F.lit(False)).alias("matches"), *shown)
    )


def _exact_type(left: DataFrame, right: DataFrame, column: str) -> T.DataType:
    """Type in which two values subtract without rounding.

    Spark drops scale from a difference that needs 39 digits, so one digit is
    left free; a value too large for that fails the job.
    """
    kinds = [df.schema[column].dataType for df in (left, right)]
    if all(isinstance(kind, T.DecimalType) for kind in kinds):
        return T.DecimalType(37, max(kind.scale for kind in kinds))
    return T.DoubleType()


def failures(comparisons: dict[str, DataFrame]) -> DataFrame:
    """(output, compared, failures), one row per comparison."""
    result = None
    for name, compared in comparisons.items():
        row = compared.agg(
            F.lit(name).alias("output"),
            F.count(F.lit(1)).alias("compared"),
            F.count_if(~F.col("matches")).alias("failures"),
        )
        result = row if result is None else result.unionByName(row)
    return result
