"""Dense surrogate keys in natural-key order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline.session import materialise

# monotonically_increasing_id() holds the partition above 33 bits of position.
POSITION_BITS = 33


def dense_key(rows: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Number distinct rows 1..n in the order of their natural key.

    Rows are range-partitioned and sorted, then written together with partition
    and position, so that neither is ever computed a second time. The offset of
    each partition comes from one count per partition; no task sees all rows.
    """
    order = [F.col(c).asc_nulls_last() for c in natural]
    slot = F.monotonically_increasing_id()
    placed = materialise(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "*",
            F.shiftright(slot, POSITION_BITS).alias("_part"),
            slot.bitwiseAND((1 << POSITION_BITS) - 1).alias("_position"),
        ),
        key,
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.col("_position") + 1).alias(key), *rows.columns
    )
