"""Fingerprints texts by Merkle trees over sections, paragraphs and pieces.

Sections are parted by an empty line, paragraphs by a line feed, and a paragraph's
pieces are runs of ``PIECE_WORDS`` words with the spaces behind them; a word goes in
parts of ``PART`` code points, each of which counts as one, so a paragraph without
spaces has pieces too. The first paragraph of a text begins with pieces of a few code
points (``HEAD``): a text of three code points or more that begins with two in one line
keeps a piece where its last third changes. A piece's digest is that of its text, every
other node's that of its children's digests. The root tells texts apart; where two
trees differ, their branches lead to the edit.

The fingerprint writes a tree as ``root|section[paragraph(piece,piece)...]...``
with shortened digests below the root.

Defined results: a null text is an empty one, which has one section with one
paragraph and no piece. Documents are ordered by descending doc_id, a null doc_id
first; rows that share a doc_id but not the text by descending hash of the text.
Rows equal in both are one document in that order and get equal results. The only
document of a table is its own next. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.keys import dense_key
from harborline.session import materialise

PIECE_WORDS = 8
PART = 8
# (code points, code points a piece) from the start of a text's first paragraph.
HEAD = [(8, 2), (56, 8)]


def pieces(paragraph: str) -> str:
    """SQL of the pieces of a paragraph."""
    return f"regexp_extract_all({paragraph}, '(?:[^ ]{{1,{PART}}} *){{1,{PIECE_WORDS}}}| +', 0)"


def first_pieces(paragraph: str) -> str:
    """SQL of the pieces of a text's first paragraph."""
    parts, begun = [], 1
    for length, size in HEAD:
        parts.append(f"regexp_extract_all(substr({paragraph}, {begun}, {length}), '[^\\n]{{1,{size}}}', 0)")
        begun += length
    return f"concat({', '.join(parts)}, {pieces(f'substr({paragraph}, {begun})')})"


def tree(text: str) -> Column:
    """Digests of pieces, as sections of paragraphs of pieces; ``text`` names a column."""
    found = f"if(a = 0 and b = 0, {first_pieces('p')}, {pieces('p')})"
    paragraph = f"transform({found}, w -> md5(w))"
    section = f"transform(split(s, '\\n', -1), (p, b) -> {paragraph})"
    return F.expr(f"transform(split(coalesce({text}, ''), '\\n\\n', -1), (s, a) -> {section})")


def leaves(nodes: str) -> Column:
    """Distinct digests of pieces, as short as the fingerprint has them."""
    return F.expr(f"array_distinct(transform(flatten(flatten({nodes})), w -> left(w, 8)))")


def paragraphs(nodes: str) -> Column:
    """Digests of all paragraphs in order."""
    return F.expr(f"transform(flatten({nodes}), p -> left(md5(array_join(p, '')), 12))")


def fingerprint(nodes: str) -> Column:
    paragraph = "md5(array_join(p, ''))"
    section = f"md5(array_join(transform(s, p -> {paragraph}), ''))"
    root = f"sha2(array_join(transform({nodes}, s -> {section}), ''), 256)"
    leaf = "array_join(transform(p, w -> left(w, 8)), ',')"
    branch = f"concat(left({paragraph}, 12), '(', {leaf}, ')')"
    branches = f"array_join(transform(s, p -> {branch}), '')"
    limb = f"concat(left({section}, 12), '[', {branches}, ']')"
    return F.expr(f"concat({root}, '|', array_join(transform({nodes}, s -> {limb}), ''))")


def likeness(left: str, right: str) -> Column:
    """Dice's coefficient of two trees' pieces; 1 for two trees without pieces."""
    both = f"size(array_intersect({left}, {right}))"
    sizes = f"(size({left}) + size({right}))"
    return F.expr(f"if({sizes} = 0, 1D, 2D * {both} / cast({sizes} as double))")


def changed_paragraphs(left: str, right: str) -> Column:
    """Where two lists of paragraph digests differ: the first differing position, and
    how many paragraphs of either lie between the common start and the common end."""
    upto = f"least(size({left}), size({right}))"
    start = (
        f"coalesce(array_min(filter(sequence(0, {upto}), "
        f"i -> not (get({left}, i) <=> get({right}, i)))), {upto})"
    )
    back = (
        f"coalesce(array_min(filter(sequence(0, {upto} - {start}), i -> i = {upto} - {start} or "
        f"not (get({left}, size({left}) - 1 - i) <=> get({right}, size({right}) - 1 - i)))), 0)"
    )
    return F.expr(
        f"named_struct('first', {start}, 'left_count', size({left}) - {start} - {back}, "
        f"'right_count', size({right}) - {start} - {back})"
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its tree's fingerprint and the digests of its paragraphs."""
    return (
        docs.select("doc_id", "text")
        .withColumn("nodes", tree("text"))
        .select("doc_id", fingerprint("nodes").alias("fingerprint"), paragraphs("nodes").alias("paragraphs"))
    )


def texts_of(docs: DataFrame) -> DataFrame:
    """Texts under two key columns that are never null: the doc_id, and a hash of the
    text and of whether there is a doc_id. Joins on them share one exchange of texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), text).alias("k2"),
        text.alias("text"),
    )


def without_id() -> Column:
    """Whether the keys are of a document without a doc_id."""
    return F.col("k2") == F.xxhash64(F.lit(True), "text")


def handovers(docs: DataFrame) -> DataFrame:
    """For each document, the one it is next to and how many code points that one takes.

    Only ids, hashes and lengths are sorted; a position joins with its neighbour.
    """
    sized = texts_of(docs).select(
        "k1", "k2", without_id().alias("no_id"), F.char_length("text").alias("n_chars")
    )
    ids = sized.select("no_id", "k1", "k2", "n_chars").distinct()
    placed = materialise(dense_key(ids, ["no_id", "k1", "k2"], "place"), "merkle-places")
    last = placed.agg(F.max("place")).first()[0] or 0
    # Descending, the document behind place p is place p - 1; behind 1 comes the last.
    taker = F.when(F.col("place") == last, F.lit(1)).otherwise(F.col("place") + 1)
    givers = placed.select("k1", "k2", taker.alias("taker"))
    takers = placed.select(
        F.col("place").alias("taker"),
        F.col("k1").alias("to_k1"),
        F.col("k2").alias("to_k2"),
        F.expr("n_chars div 3").cast("int").alias("takes"),
    )
    return givers.join(takers, "taker").drop("taker")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, whose last third
    gave way to the start of the next document, and their likeness."""
    texts = texts_of(docs)
    table = materialise(handovers(docs), "merkle-handovers")
    given = (
        texts.join(table, ["k1", "k2"])
        .select("to_k1", "to_k2", "takes", "text")
        .withColumn("nodes", tree("text"))
        .select(
            F.col("to_k1").alias("k1"),
            F.col("to_k2").alias("k2"),
            F.expr("left(text, takes)").alias("start_of_next"),
            # Four bytes a leaf on the way to the neighbour.
            F.unhex(F.array_join(leaves("nodes"), "")).alias("packed"),
        )
        .dropDuplicates(["k1", "k2"])
    )
    both = texts.join(given, ["k1", "k2"]).select(
        F.when(~without_id(), F.col("k1")).alias("doc_id"),
        F.char_length("text").alias("n_chars"),
        "text",
        "start_of_next",
        F.regexp_extract_all(F.lower(F.hex("packed")), F.lit(".{8}"), F.lit(0)).alias("next_leaves"),
    )
    kept = "left(text, n_chars - n_chars div 3)"
    return (
        both.withColumn("edited", F.expr(f"concat({kept}, start_of_next)"))
        .withColumn("nodes", tree("text"))
        .withColumn("edited_nodes", tree("edited"))
        .withColumn("own_leaves", leaves("nodes"))
        .withColumn("edited_leaves", leaves("edited_nodes"))
        .withColumn("own_paragraphs", paragraphs("nodes"))
        .withColumn("edited_paragraphs", paragraphs("edited_nodes"))
        .select(
            "doc_id",
            F.col("n_chars").cast("bigint").alias("n_chars"),
            "edited",
            fingerprint("nodes").alias("fingerprint"),
            fingerprint("edited_nodes").alias("edited_fingerprint"),
            likeness("own_leaves", "edited_leaves").alias("near_edited"),
            likeness("own_leaves", "next_leaves").alias("near_next"),
            changed_paragraphs("own_paragraphs", "edited_paragraphs").alias("edit"),
        )
    )
