"""Drops lines that many documents repeat, keeping them in one document.

Line hashes are range-partitioned and sorted by document and position, so that
each partition streams over its lines and sees every document's first occurrence
once. What comes back per document is a sparse bitmap of its lines, never text.

A key is a line without the white space at its ends, A-Z lower-cased. Keys of at
least ``min_chars`` code points found in at least ``min_docs`` documents lose all
their lines except those of the largest doc_id that holds the key.

Defined results: a null or empty text has one empty line, which is never dropped.
Rows that share a doc_id are one document when documents are counted. A null
doc_id is one document, smaller than any other. Repeated rows get equal results.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline.llm.common import SPACES, ascii_lower, same, whole_row
from harborline.session import materialise

MIN_CHARS = 40
MIN_DOCS = 5
# A key has one part per this many lines in all, so that a line of a third of all
# documents is shared out however many there are.
LINES_A_PART = 50_000
WORD = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that is long enough: two hashes, document and position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = F.transform(split_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(SPACES)))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(keys))
    return lines.where(F.char_length("col") >= min_chars).select(
        F.xxhash64("col").alias("h1"),
        F.xxhash64(F.lit(1), F.col("col")).alias("h2"),
        "doc_id",
        "text_hash",
        F.col("pos").alias("line"),
    )


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys of enough documents and the document that keeps them, once for every salt
    a key occurs with, so that a common line is shared out when lines meet their keys."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("line").asc()]
    placed = lines.repartitionByRange("h1", "h2", "salt").sortWithinPartitions(
        "h1", "h2", "salt", *order
    )
    stream = W.partitionBy("h1", "h2", "salt").orderBy(*order)
    before = F.lag("doc_id").over(stream)
    first = (F.row_number().over(stream) == 1) | ~before.eqNullSafe(F.col("doc_id"))
    occurrences = placed.select("h1", "h2", "salt", "doc_id", first.alias("is_first"))
    by_part = materialise(
        occurrences.groupBy("h1", "h2", "salt").agg(
            F.count_if("is_first").alias("part_docs"), F.max("doc_id").alias("part_keeper")
        ),
        "line-parts",
    )
    repeated = (
        by_part.groupBy("h1", "h2")
        .agg(F.sum("part_docs").alias("n_docs"), F.max("part_keeper").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    return by_part.select("h1", "h2", "salt").join(repeated, ["h1", "h2"])


def drop_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Per document with dropped lines, a bitmap as map of word -> 64 bits.

    A word that is not in the map has no dropped line; a set bit drops its line.
    Documents are named by doc_id and the hash of their text.
    """
    hashes = materialise(line_hashes(docs, min_chars), "line-hashes")
    salts = max(-(-hashes.count() // LINES_A_PART), 1)
    lines = hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    dropped = lines.join(repeated_keys(lines, min_docs), ["h1", "h2", "salt"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    )
    bit = F.expr(f"shiftleft(cast(1 as bigint), cast(line % {WORD} as int))")
    words = dropped.groupBy(
        "doc_id", "text_hash", F.expr(f"cast(line div {WORD} as int)").alias("word")
    ).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_bitmap")
    )


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Adds ``lines``, all lines of the text, and ``kept``, those that stay."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("_hash", text_hash).alias("d")
    marks = bitmaps.alias("m")
    joined = keyed.join(
        marks,
        same((F.col("d.doc_id"), F.col("m.doc_id")), (F.col("d._hash"), F.col("m.text_hash"))),
        "left",
    )
    kept = F.expr(
        "filter(lines, (l, i) -> drop_bitmap is null or "
        f"shiftright(coalesce(drop_bitmap[cast(i div {WORD} as int)], 0L), cast(i % {WORD} as int)) & 1L = 0)"
    )
    return joined.select(
        *[F.col(f"d.`{c}`") for c in docs.columns],
        split_lines(F.col("d.text")).alias("lines"),
        "drop_bitmap",
    ).withColumn("kept", kept)


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Per document: number of lines, number dropped, and the kept text."""
    narrow = docs.select("doc_id", "text")
    kept = with_kept_lines(narrow, drop_bitmaps(narrow, min_chars, min_docs))
    return kept.select(
        "doc_id",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept_text"),
        "drop_bitmap",
    )


def without_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """All documents with their columns, the text without the dropped lines. Where the
    table has ``n_chars``, it is the new text's number of code points. Other columns may
    have any names and stay as they are."""
    rows = docs.select(whole_row(docs), "doc_id", "text")
    kept = with_kept_lines(rows, drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        size = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(size, F.col("row.n_chars"))
    return kept.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
