"""Finds benchmark passages in documents by winnowing.

A window is ``window`` consecutive words of an item; an item of fewer words, but
not none, is one window. Of the k-gram hashes inside a window the least is its
fingerprint. Equal windows have equal fingerprints, so joining the documents'
fingerprints with the benchmark's loses no shared window. The hits are extended
to the document windows behind them, which are compared word for word.

Everything is a DataFrame expression. Texts meet the matches again only where a
fingerprint was hit, and Spark broadcasts a side only by its measured size.

Defined results: null texts have no words, so they are neither hit nor windows;
a null item_id is not counted or listed. Repeated rows of documents get one
result each; rows of one item_id are one item. Rows that share a doc_id but not
the text are told apart. Empty tables give no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import ascii_lower, same, whole_row
from harborline.session import materialise

WINDOW = 10
GRAM = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["doc_id", "text_hash"]


def words_of(text: Column) -> Column:
    pieces = F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1)
    return F.filter(pieces, lambda word: word != "")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def gram_hashes(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    return F.expr(
        f"if(size({words}) < {size}, array(), transform(sequence(1, size({words}) - {size - 1}), "
        f"i -> xxhash64(slice({words}, i, {size}))))"
    )


def sliding_least(hashes: str, count: int) -> Column:
    """The least of each ``count`` neighbouring hashes."""
    return F.expr(
        f"if(size({hashes}) < {count}, array(), transform(sequence(1, size({hashes}) - {count - 1}), "
        f"i -> array_min(slice({hashes}, i, {count}))))"
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (their words joined by a space) and the items they are in."""
    worded = items.select("item_id", words_of(F.col("text")).alias("words")).where(
        F.size("words") > 0
    )
    parts = F.expr(
        f"transform(sequence(1, greatest(size(words) - {window - 1}, 1)), "
        f"i -> slice(words, i, {window}))"
    )
    each = worded.select("item_id", F.explode(parts).alias("part"))
    return each.select(
        F.array_join("part", " ").alias("window_text"), F.size("part").alias("length"), "item_id"
    ).distinct()


def window_fingerprints(windows: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct (length, h) under which document windows are looked up."""
    worded = windows.select("length", F.split("window_text", " ").alias("words"))
    least = F.array_min(gram_hashes("words", gram))
    hashed = F.when(F.col("length") == window, least).otherwise(F.xxhash64("words"))
    return worded.select("length", hashed.alias("h")).distinct()


def document_fingerprints(
    docs: DataFrame, lengths: list[int], window: int, gram: int
) -> DataFrame:
    """One row per document with its number of words (length 0), and one per run of
    windows with equal fingerprints: first and last start of the run."""
    rows = docs.select("doc_id", text_hash().alias("text_hash"), words_of(F.col("text")).alias("words"))
    # The row without a fingerprint has a hash of its own, so that a join spreads it.
    lists = [
        "array(named_struct('length', 0, 'h', text_hash, 'first', 0, 'last', size(words)))"
    ]
    for length in lengths:
        own = f"prints_{length}"
        if length == window:
            rows = rows.withColumn("grams", gram_hashes("words", gram))
            rows = rows.withColumn(own, sliding_least("grams", window - gram + 1)).drop("grams")
        else:
            rows = rows.withColumn(own, gram_hashes("words", length))
        starts = f"starts_{length}"
        rows = rows.withColumn(
            starts,
            F.expr(
                f"if(size({own}) = 0, array(), filter(sequence(0, size({own}) - 1), "
                f"i -> i = 0 or {own}[i] <> {own}[greatest(i - 1, 0)]))"
            ),
        )
        lists.append(
            f"transform({starts}, (s, j) -> named_struct('length', {length}, 'h', {own}[s], "
            f"'first', s, 'last', coalesce(get({starts}, j + 1), size({own})) - 1))"
        )
    return rows.select(*KEY, F.inline(F.expr(f"concat({', '.join(lists)})")))


def fingerprint_hits(docs: DataFrame, prints: DataFrame, window: int, gram: int) -> DataFrame:
    """Per document: words, copies of the row and the runs whose fingerprint was hit."""
    lengths = [r[0] for r in prints.select("length").distinct().orderBy("length").collect()]
    rows = document_fingerprints(docs, lengths, window, gram)
    marked = rows.join(prints.withColumn("hit", F.lit(True)), ["length", "h"], "left")
    counts = F.col("length") == 0
    return (
        marked.where(counts | F.col("hit"))
        .groupBy(*KEY)
        .agg(
            F.max(F.when(counts, F.col("last"))).cast("bigint").alias("n_words"),
            F.count_if(counts).cast("int").alias("copies"),
            F.collect_set(F.when(~counts, F.struct("length", "first", "last"))).alias("runs"),
        )
    )


def matched_windows(docs: DataFrame, hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Extends hit fingerprints: document windows that are an item's, word for word."""
    found = hits.where(F.size("runs") > 0).select(*KEY, "runs")
    texts = docs.select("doc_id", text_hash().alias("text_hash"), "text").alias("d")
    both = texts.join(
        found.alias("f"),
        same(
            (F.col("d.doc_id"), F.col("f.doc_id")), (F.col("d.text_hash"), F.col("f.text_hash"))
        ),
    ).select("d.doc_id", "d.text_hash", "runs", words_of(F.col("text")).alias("words"))
    spans = F.expr(
        "flatten(transform(runs, r -> transform(sequence(r.first, r.last), s -> named_struct("
        "'start', s, 'length', r.length, "
        "'window_text', array_join(slice(words, s + 1, r.length), ' ')))))"
    )
    return both.select(*KEY, F.inline(spans)).join(windows, ["window_text", "length"])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """Per document: n_words, the hit words (``ranges`` of [start, stop) and n_hit) and
    the sorted ids of the items with a window in it."""
    windows = materialise(item_windows(items, window), "item-windows")
    prints = materialise(window_fingerprints(windows, window, gram), "item-prints")
    hits = materialise(fingerprint_hits(docs, prints, window, gram), "print-hits")
    matched = matched_windows(docs, hits, windows)
    stop = (F.col("start") + F.col("length")).alias("stop")
    by_doc = matched.groupBy(*KEY).agg(
        F.array_sort(F.collect_set(F.struct("start", stop))).alias("ranges"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    joined = hits.alias("h").join(
        by_doc.alias("m"),
        same(
            (F.col("h.doc_id"), F.col("m.doc_id")), (F.col("h.text_hash"), F.col("m.text_hash"))
        ),
        "left",
    )
    n_hit = F.expr(
        "aggregate(ranges, named_struct('n', 0, 'upto', 0), (acc, x) -> named_struct("
        "'n', acc.n + greatest(0, x.stop - greatest(x.start, acc.upto)), "
        "'upto', greatest(acc.upto, x.stop)), acc -> acc.n)"
    )
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return joined.select("h.doc_id", "h.text_hash", "n_words", "ranges", "items", copies).select(
        *KEY,
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("ranges", F.expr("array()")).alias("ranges"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that hold no window of any item, with all their columns, whatever
    the names of these."""
    marks = decontaminate(docs.select("doc_id", "text"), items, **settings)
    hit = marks.where(F.col("n_hit") > 0).select(*KEY).distinct().alias("m")
    rows = docs.select(whole_row(docs), "doc_id", text_hash().alias("text_hash")).alias("d")
    condition = same(
        (F.col("d.doc_id"), F.col("m.doc_id")), (F.col("d.text_hash"), F.col("m.text_hash"))
    )
    return rows.join(hit, condition, "left_anti").select("row.*")
