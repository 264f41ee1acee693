"""Small constant tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def inline_table(spark: SparkSession, columns: str, rows: Sequence[Sequence]) -> DataFrame:
    """A ``VALUES`` table; text and whole numbers only."""

    def literal(value) -> str:
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(int(value))

    values = ", ".join(f"({', '.join(literal(v) for v in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
