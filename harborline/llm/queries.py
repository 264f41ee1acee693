"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline import session
from harborline.llm import (
    collocations,
    decontamination,
    language,
    line_dedup,
    merkle,
    mixing,
    pii,
    quality_trees,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    warc,
)
from harborline.llm.common import documents, with_package
from harborline.llm.sql import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(session.tune(with_package(spark)), sf_dir)

    QUERIES[build.__name__] = run
    return build


def sha256(text) -> Column:
    return F.sha2(text, 256)


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(
        documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.edited_fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_chars",
        sha256("edited").alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.read_records(warc.write_archives(pages))
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(documents(spark, sf_dir), window=50)
    return kept.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir))
    counts = [
        F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
        for kind in pii.KINDS
    ]
    return found.select(
        "doc_id", *counts, sha256(_joined("base")).alias("base_sha256"), _joined("spans").alias("spans")
    )


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
