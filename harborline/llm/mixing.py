"""Mixes sources to target weights by capped water-filling.

A share of the whole is dealt to the sources by weight. A source stops at
``max_epochs`` times its size; what it cannot take goes to the others by weight,
again and again until none is above. Every document is then taken as many whole
times as its source's number of epochs holds, plus one fractional repetition,
whose last word is drawn with a seed.

Sizes and weights are integers and each target is one division of integers, so
reruns agree in every bit.

Defined results: a null text has size 0; a null source is a source of its own,
last in order. A source without words has target 0. Repeated rows count each
time and draw alike. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import SPACED_WORD, same, uniform
from harborline.operators.keys import dense_key
from harborline.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words, as a fraction: 150 %
MAX_EPOCHS = 2
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")


def weighted_sources(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """One row per source with its size and, by its place in order, its weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Strings are ordered by their UTF-8 bytes, which is the order of code points.
    placed = dense_key(totals, ["source"], "place")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    turn = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    return placed.select(
        "source", "source_size", F.element_at(cycle, turn).cast("bigint").alias("weight")
    )


def water_fill(sources: DataFrame, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Adds each source's target. Only totals over all sources reach the driver."""
    up, down = share
    # Products of sizes and weights pass 64 bits.
    def exact(number: Column | int) -> Column:
        return (number if isinstance(number, Column) else F.lit(str(number))).cast("decimal(38,0)")

    cap = exact(F.col("source_size")) * max_epochs
    weight = exact(F.col("weight"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal = up * total  # in units of 1/down word
    filled, left_weight = 0, None
    while True:
        # A source is full when its part of what is left reaches its cap:
        # weight * (goal - filled) / left_weight >= cap * down.
        if left_weight is None:
            full = F.lit(False)
        elif left_weight == 0:
            full = F.lit(True)
        else:
            part = weight * exact(goal - filled)
            full = part >= cap * down * exact(left_weight)
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, exact(cap * down))), exact(0)).alias("filled"),
            F.coalesce(F.sum(F.when(~full, weight)), exact(0)).alias("weight"),
        ).first()
        if (row.filled, row.weight) == (filled, left_weight):
            break
        filled, left_weight = int(row.filled), int(row.weight)
    if left_weight == 0:
        target = cap.cast("double")
    else:
        part = weight * exact(goal - filled)
        target = F.when(full, cap.cast("double")).otherwise(
            part.cast("double") / F.lit(float(down * left_weight))
        )
    return sources.withColumn("target", target)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: source, size, target of its source, whole repetitions, words
    of the fractional repetition, and all words taken."""
    sizes = materialise(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes"
    )
    sources = materialise(weighted_sources(sizes, weights), "mix-sources")
    targets = water_fill(sources, share, max_epochs)
    joined = sizes.alias("d").join(
        targets.alias("s"), same((F.col("d.source"), F.col("s.source"))), "left"
    )
    wanted = F.when(
        F.col("source_size") > 0,
        F.col("size").cast("double") * F.col("target") / F.col("source_size").cast("double"),
    ).otherwise(F.lit(0.0))
    drawn = F.floor(F.col("wanted") + uniform(seed, F.col("doc_id"))).cast("bigint")
    taken = F.least(drawn, F.col("size") * max_epochs)
    return (
        joined.select("doc_id", "d.source", "size", "source_size", "target", wanted.alias("wanted"))
        .withColumn("taken", taken)
        .withColumn("repeats", F.expr("if(size > 0, taken div size, 0L)"))
        .withColumn("extra_words", F.col("taken") - F.col("repeats") * F.col("size"))
        .drop("wanted")
    )


def repeated_texts(mixed: DataFrame) -> DataFrame:
    """Expands a mix that carries ``text``: whole copies, then the part of a copy.

    The part starts at a seeded word and goes round the end, so that no document
    gives its first words only.
    """
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"({SPACED_WORD})"))
    start = F.floor(uniform(SEED + 1, F.col("doc_id")) * F.col("size")).cast("int")
    twice = F.concat(words, words)
    part = F.array_join(F.slice(twice, start + 1, F.col("extra_words").cast("int")), " ")
    copies = F.expr("if(repeats > 0, array_repeat(text, cast(repeats as int)), array())")
    last = F.when(F.col("extra_words") > 0, F.array(part)).otherwise(F.expr("array()"))
    return mixed.select("doc_id", "source", F.explode(F.concat(copies, last)).alias("text"))
