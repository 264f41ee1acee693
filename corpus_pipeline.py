"""Prepares a training corpus: five stages over ``documents``, each written as Parquet.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents`` for what they keep:

1. toxicity: documents that the grammar scores at 0.7 or more go.
2. line dedup: lines that many documents repeat stay in one document; texts shrink.
3. SimHash near-dedup: one document of each group stays, that with the least doc_id.
4. benchmark decontamination: documents that hold a window of an item go.
5. mixing: how often each document that is left is taken to meet the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline import session
from harborline.llm import decontamination, line_dedup, mixing, simhash, toxicity
from harborline.llm.common import documents, with_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.civil_documents(docs, documents(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_component(docs, shingle=4, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "repeats", "extra_words", "taken"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# Scores of a fitted model and XXH64 fingerprints cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each reads what the one before wrote."""
    session.tune(with_package(spark))
    docs = documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = session.materialise(docs, "stage-" + name.replace(" ", "-"))
    return docs
