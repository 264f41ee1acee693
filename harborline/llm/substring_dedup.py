"""Removes passages that documents with smaller ids hold already.

A window is ``window`` consecutive words of one document. A word goes if it lies
in a window whose words also start, in order, in a document with a smaller doc_id;
windows are judged on the input, not on what is left.

Three passes over the texts:

1. Every window is stood for by its anchor, the least hash of the word groups
   inside it. Neighbouring windows mostly share theirs and form a segment; the
   segments are written with 128-bit hashes, once per document however often it
   repeats them. Each partition counts its anchors in a count-min sketch, and the
   sketches are merged cell by cell. Equal windows have equal anchors, so an anchor
   of several documents is never counted once only.
2. Windows whose anchor is estimated once are dropped, the others grouped exactly.
   Where all segments of an anchor are equal, they are compared as a whole. Where
   they differ, the windows inside them are read again, hashed and compared.
3. Documents meet their ranges and lose them.

Defined results: a null text has no words. A null doc_id is larger than any other.
Rows that share a doc_id are one document and never lose words to each other; rows
equal in text too are handled alike. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import same
from harborline.session import materialise

WINDOW = 50
GRAM = 8
DEPTH = 2
# One cell per so many bytes of text is about four per anchor. The upper bound
# holds a worker's counters at 256 MB and the broadcast bits at 32 MB; beyond it
# the sketch lets more windows through to the exact grouping, and loses none.
BYTES_PER_CELL = 32
MIN_CELLS = 1 << 16
MAX_CELLS = 1 << 27
# Longer runs of one anchor (repetitive texts) are cut, so rows stay small.
SEGMENT = 64
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
LAST = (1 << 63) - 1


def inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = values ^ np.uint64(seed * 0x5851F42D4C957F2D % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    least, span = values, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Hashed:
    """Two polynomial prefix sums over a document's word hashes."""

    def __init__(self, words: list[bytes]):
        digests = b"".join(map(xxhash.xxh3_128_digest, words))
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        count = len(words)
        self.sums, self.back = [], []
        for column, base in enumerate(BASES):
            total = np.zeros(count + 1, np.uint64)
            np.cumsum(pairs[:, column] * powers(base, count), dtype=np.uint64, out=total[1:])
            self.sums.append(total)
            self.back.append(powers(inverse(base), count + 1))

    def spans(self, stream: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words in [start, stop), the same wherever they stand."""
        total = self.sums[stream]
        return (total[stop] - total[start]) * self.back[stream][start]

    def every(self, stream: int, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, in order."""
        total = self.sums[stream]
        count = len(total) - size
        return (total[size:] - total[:count]) * self.back[stream][:count]


def anchors(hashed: Hashed, window: int, gram: int) -> np.ndarray:
    """The anchor of each window, in order."""
    return sliding_min(mixed(hashed.every(0, gram)), window - gram + 1)


def cells(values: np.ndarray, row: int, width: int) -> np.ndarray:
    return mixed(values, row + 1) & np.uint64(width - 1)


# Words that one document holds several times are one row: ``start`` is their first
# place, ``again`` the other places as packed 32-bit numbers, null where there are none.
SEGMENTS = (
    "doc_id bigint, text_hash bigint, anchor bigint, s1 bigint, s2 bigint, start int, "
    "again binary, count int"
)
WINDOWS = "doc_id bigint, text_hash bigint, w1 bigint, w2 bigint, start int, again binary"


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def begins_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal anchors begin and end, long runs cut."""
    begins = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[begins[1:], len(least)]
    if (ends - begins).max() > SEGMENT:
        pieces = [np.arange(b, e, SEGMENT) for b, e in zip(begins, ends)]
        limits = np.repeat(ends, [len(p) for p in pieces])
        begins = np.concatenate(pieces)
        ends = np.minimum(begins + SEGMENT, limits)
    return begins, ends


def folded(spans: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first row of each pair of hashes, and the starts of its other rows."""
    rows = np.arange(len(starts))
    if len(np.unique(spans[0])) == len(starts):
        return rows, pa.nulls(len(starts), pa.binary())
    order = np.lexsort((rows, spans[1], spans[0]))
    fresh = np.r_[True, np.zeros(len(rows) - 1, bool)]
    for values in spans:
        fresh[1:] |= values[order][1:] != values[order][:-1]
    begins = np.flatnonzero(fresh)
    ends = np.r_[begins[1:], len(rows)]
    placed = starts[order].astype("<i4")
    again = [placed[b + 1 : e].tobytes() or None for b, e in zip(begins, ends)]
    return order[begins], pa.array(again, pa.binary())


def long_texts(batch: pa.RecordBatch, window: int):
    """Ids, hash of the text and words of the documents that have a window."""
    columns = (batch.column(c) for c in ("doc_id", "text_hash", "text"))
    for doc_id, text_hash, text in zip(*columns):
        words = (text.as_py() or b"").split()
        if len(words) >= window:
            yield doc_id.as_py(), text_hash.as_py(), words


def keyed(doc_id, text_hash, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    size = len(columns[0])
    ids = pa.array([doc_id], pa.int64()).take(pa.array(np.zeros(size, np.int32)))
    hashes = pa.array(np.full(size, text_hash, np.int64))
    return pa.RecordBatch.from_arrays([ids, hashes, *columns], ["doc_id", "text_hash", *names])


def segment_partition(
    batches: Iterator[pa.RecordBatch], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """All segments of the partition's documents."""
    for batch in batches:
        for doc_id, text_hash, words in long_texts(batch, window):
            hashed = Hashed(words)
            least = anchors(hashed, window, gram)
            begins, ends = begins_of(least)
            spans = [hashed.spans(i, begins, ends + (window - 1)) for i in (0, 1)]
            rows, again = folded(spans, begins)
            first = begins[rows]
            yield keyed(
                doc_id,
                text_hash,
                [
                    signed(least[first]),
                    *[signed(values[rows]) for values in spans],
                    pa.array(first.astype(np.int32)),
                    again,
                    pa.array((ends[rows] - first).astype(np.int32)),
                ],
                ["anchor", "s1", "s2", "start", "again", "count"],
            )


def window_partition(
    batches: Iterator[pa.RecordBatch], bits, texts, window: int, gram: int, width: int
) -> Iterator[pa.RecordBatch]:
    """The windows whose anchor is marked in ``bits``, of the texts marked in ``texts``."""
    for batch in batches:
        known = batch.column("text_hash").to_numpy(zero_copy_only=False).view(np.uint64)
        batch = batch.filter(pa.array(marked(known, texts.value, width)))
        for doc_id, text_hash, words in long_texts(batch, window):
            hashed = Hashed(words)
            starts = np.flatnonzero(marked(anchors(hashed, window, gram), bits.value, width))
            if len(starts):
                spans = [hashed.spans(i, starts, starts + window) for i in (0, 1)]
                rows, again = folded(spans, starts)
                yield keyed(
                    doc_id,
                    text_hash,
                    [
                        *[signed(values[rows]) for values in spans],
                        pa.array(starts[rows].astype(np.int32)),
                        again,
                    ],
                    ["w1", "w2", "start", "again"],
                )


def sketch_partition(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One partition's sketch: its cells that are not empty, counted up to two."""
    counts = np.zeros((DEPTH, width), np.uint8)
    for batch in batches:
        values = batch.column("anchor").to_numpy().view(np.uint64)
        for row in range(DEPTH):
            touched, times = np.unique(cells(values, row, width), return_counts=True)
            touched = touched.astype(np.int64)
            counts[row, touched] = np.minimum(counts[row, touched] + np.minimum(times, 2), 2)
    for row in range(DEPTH):
        touched = np.flatnonzero(counts[row])
        for at in range(0, len(touched), 100_000):
            part = touched[at : at + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part + row * width), pa.array(counts[row, part].astype(np.int32))],
                ["cell", "n"],
            )


def cell_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The cells of the values in the first column."""
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        found = [cells(values, row, width).astype(np.int64) + row * width for row in range(DEPTH)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["cell"])


def gathered_bits(cell: DataFrame, width: int) -> np.ndarray:
    """A bit per cell; at most DEPTH * width bits come to the driver, whatever the input."""
    words = cell.groupBy(F.expr("cell div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cell % 64 as int))")).alias("bits")
    )
    table = words.toArrow()
    bits = np.zeros(max(DEPTH * width // 64, 1), np.uint64)
    bits[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def marked(values: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which values have their bit set in every row."""
    found = np.ones(len(values), bool)
    for row in range(DEPTH):
        cell = cells(values, row, width) + np.uint64(row * width)
        found &= (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def marked_rows(batches: Iterator[pa.RecordBatch], bits, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("anchor").to_numpy().view(np.uint64)
        yield batch.filter(pa.array(marked(values, bits.value, width)))


def order_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(LAST))


def sketch_width(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(size // BYTES_PER_CELL, MIN_CELLS)
    return min(1 << (wanted - 1).bit_length(), MAX_CELLS)


def removed_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document that loses words, the ranges [start, stop) of words it loses,
    named by doc_id and the hash of its text. ``again`` holds further starts of ranges
    of the same length. Ranges may overlap."""
    spark = docs.sparkSession
    context = spark.sparkContext
    width = sketch_width(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("text"),
    )
    segments = materialise(
        texts.mapInArrow(lambda b: segment_partition(b, window, gram), SEGMENTS), "segments"
    )
    parts = segments.select("anchor").mapInArrow(
        lambda b: sketch_partition(b, width), "cell bigint, n int"
    )
    merged = parts.groupBy("cell").agg(F.sum("n").alias("n")).where("n >= 2")
    repeated = context.broadcast(gathered_bits(merged, width))
    likely = materialise(
        segments.mapInArrow(lambda b: marked_rows(b, repeated, width), SEGMENTS), "likely-segments"
    )

    by_segment = likely.groupBy("anchor", "s1", "s2").agg(
        F.min(order_of()).alias("low"), F.max(order_of()).alias("high")
    )
    by_anchor = materialise(
        by_segment.groupBy("anchor")
        .agg(
            F.count(F.lit(1)).alias("kinds"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .where("low < high"),
        "repeated-anchors",
    )
    stop = (F.col("start") + F.col("count") + (window - 1)).alias("stop")
    whole = (
        likely.join(by_anchor.where("kinds = 1"), "anchor")
        .where(order_of() > F.col("low"))
        .select("doc_id", "text_hash", "start", stop, "again")
    )

    differing = by_anchor.where("kinds > 1").select("anchor")
    touched = likely.join(differing, "anchor").select("text_hash").distinct()

    def bits_of(values: DataFrame):
        rows = values.mapInArrow(lambda b: cell_rows(b, width), "cell bigint")
        return context.broadcast(gathered_bits(rows, width))

    anchor_bits, text_bits = bits_of(differing), bits_of(touched)
    windows = texts.mapInArrow(
        lambda b: window_partition(b, anchor_bits, text_bits, window, gram, width), WINDOWS
    )
    firsts = (
        windows.groupBy("w1", "w2")
        .agg(F.min(order_of()).alias("low"), F.max(order_of()).alias("high"))
        .where("low < high")
        .select("w1", "w2", "low")
    )
    single = (
        windows.join(firsts, ["w1", "w2"])
        .where(order_of() > F.col("low"))
        .select("doc_id", "text_hash", "start", (F.col("start") + window).alias("stop"), "again")
    )
    return (
        whole.unionByName(single)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "stop", "again")).alias("ranges"))
    )


def cut(words: list[bytes], ranges: pa.StructArray) -> list[bytes]:
    """The words outside all ranges."""
    edges = np.zeros(len(words) + 1, np.int64)
    starts, stops = (ranges.field(c).to_numpy() for c in ("start", "stop"))
    np.add.at(edges, starts, 1)
    np.add.at(edges, stops, -1)
    for start, stop, again in zip(starts, stops, ranges.field("again")):
        if again.is_valid:
            others = np.frombuffer(again.as_py(), "<i4")
            np.add.at(edges, others, 1)
            np.add.at(edges, others + (stop - start), -1)
    stay = np.cumsum(edges)[:-1] == 0
    return [word for word, keep in zip(words, stay.tolist()) if keep]


def cut_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, after, kept = [], [], []
        for text, ranges in zip(batch.column("text"), batch.column("ranges")):
            words = text.as_py().split()
            before.append(len(words))
            if ranges.is_valid:
                words = cut(words, ranges.values)
            after.append(before[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(before, pa.int64()),
                pa.array(after, pa.int64()),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: n_words, n_removed and the kept words joined by one space."""
    ranges = removed_ranges(docs, window, gram)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        text.cast("binary").alias("text"),
    )
    marks = same(
        (F.col("d.doc_id"), F.col("r.doc_id")), (F.col("d.text_hash"), F.col("r.text_hash"))
    )
    joined = texts.alias("d").join(ranges.alias("r"), marks, "left")
    kept = joined.select("d.doc_id", "text", "ranges").mapInArrow(
        cut_partition, "doc_id bigint, n_words bigint, n_removed bigint, kept binary"
    )
    return kept.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed(
        "kept", "kept_text"
    )
