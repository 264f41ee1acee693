"""Mines phrase collocations by the stripes pattern.

A first word keys a stripe, the associative counter of what comes next: the next word,
and the next words up to the longest phrase. Tasks count a slice of text at a time and
send stripes, not single pairs; stripes of one word are merged elementwise where they
meet. Merged stripes hold all that is needed: their entries are the counts of the
extensions, the sum of their next words, to which the end of a piece belongs, is the
word's own count, and their longer entries tell which shorter phrases are subsumed.

The stripe of a common word is cut into parts by a hash of the next words. How many
follows from a sketch of the words, ``CELLS`` hashed cells whose sums are at least the
counts of the words in them: one part for every ``PART_WORDS`` occurrences, rounded up
to a power of two. So no part gathers what comes next in the whole corpus, and rare words
stay in one piece. Sums and greatest entries of the parts are combined afterwards.

Defined results: null texts count as empty and hold no words; a null language counts as
``und``, together with documents whose language is ``und``. Repeated rows count each
time. Numbers are exact: counts are 64-bit, products decimals of 38 digits, which holds
to counts of 10^16. Ties go to the greater count, then to the lesser phrase by bytes.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborline.session import materialise

CUTS = r"[.,;:!?\n\x0b\x0c\r]+"
WORDS = 3
LEAST = 10
SUBSUMED = 50
TOP = 2000
SCALE = 1_000_000
PART_WORDS = 1 << 19
# Text a task counts at a time, and rows it hands on at a time.
SLICE_BYTES = 4 << 20
ROWS = 50_000
# Rows that are ranked in one group, on average.
GROUP = 1_000_000
# Stands for the end of a piece among next words; no word holds it.
END = "\n"
# Cells of the sketch, and of a block of them that is summed in one place.
CELLS = 1 << 20
BLOCK = 1 << 16
STRIPES = "lang string, prefix string, part int, nexts string, counts string"
COUNTS = "lang string, phrase string, words int, n bigint, longer bigint"
EXACT = "decimal(38,0)"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``SLICE_BYTES`` of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths), 0
    while at < len(ends):
        until = ends[at - 1] + SLICE_BYTES if at else SLICE_BYTES
        after = max(int(np.searchsorted(ends, until, "right")), at + 1)
        yield batch.slice(at, after - at)
        at = after


def words_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words; of each word in turn its number, its piece and its row."""
    texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
    cut = pc.split_pattern_regex(texts, CUTS)
    split = pc.split_pattern(pc.replace_substring(pc.list_flatten(cut), "\t", " "), " ")
    words = pc.list_flatten(split)
    held = pc.not_equal(words, "")
    coded = pc.dictionary_encode(words.filter(held))
    piece = pc.list_parent_indices(split).filter(held).to_numpy()
    row = pc.list_parent_indices(cut).to_numpy()[piece]
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece, row


def joined_lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """Texts of consecutive values, joined by spaces, one per start."""
    offsets = pa.array(np.append(starts, len(values)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), " ")


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for column in columns:
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def striped(
    lang: pa.Array, prefix: pa.Array, owner: np.ndarray, part: np.ndarray, nexts: pa.Array, counts: np.ndarray
) -> pa.RecordBatch:
    """Stripes of entries that are in the order of their owner and part. ``lang`` and
    ``prefix`` belong to owners, the rest to entries."""
    starts = starts_of(owner, part)
    owners = pa.array(owner[starts])
    return pa.RecordBatch.from_arrays(
        [
            lang.take(owners), prefix.take(owners), pa.array(part[starts].astype(np.int32)),
            joined_lists(nexts, starts),
            joined_lists(pa.array(counts, pa.int64()).cast(pa.string()), starts),
        ],
        ["lang", "prefix", "part", "nexts", "counts"],
    )


def in_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def cells_of(words: pa.Array) -> np.ndarray:
    hashed = [xxhash.xxh64_intdigest(word) for word in words.cast(pa.binary()).to_pylist()]
    return (np.array(hashed, np.uint64) % np.uint64(CELLS)).astype(np.int64)


def word_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a task fall into each cell, packed by block."""
    sums = np.zeros(CELLS, np.int64)
    for batch in batches:
        for rows in slices(batch):
            words, word, _, _ = words_of(rows)
            np.add.at(sums, cells_of(words), np.bincount(word, minlength=len(words)))
    for block, part in enumerate(sums.reshape(-1, BLOCK)):
        places = np.flatnonzero(part)
        if len(places):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int32()),
                    pa.array([places.astype(np.uint16).tobytes()], pa.binary()),
                    pa.array([part[places].tobytes()], pa.binary()),
                ],
                ["block", "places", "counts"],
            )


def summed_cells(batches: Iterator[pa.RecordBatch], part_words: int) -> Iterator[pa.RecordBatch]:
    """Of each cell of a block the power of two that its words' stripes are cut into."""

    def powers(block: int, sums: np.ndarray) -> pa.RecordBatch:
        found = np.ceil(np.log2(np.maximum(sums / part_words, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["block", "powers"]
        )

    open_block, sums = None, np.zeros(BLOCK, np.int64)
    for batch in batches:
        for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts"))):
            if block != open_block:
                if open_block is not None:
                    yield powers(open_block, sums)
                open_block, sums = block, np.zeros(BLOCK, np.int64)
            # Places differ within a row.
            sums[np.frombuffer(places, np.uint16)] += np.frombuffer(counts, np.int64)
    if open_block is not None:
        yield powers(open_block, sums)


def part_powers(texts: DataFrame, part_words: int) -> np.ndarray:
    """A byte per cell: 1 MB, whatever the input."""
    hit = texts.mapInArrow(word_cells, "block int, places binary, counts binary")
    together = hit.repartition("block").sortWithinPartitions("block")
    found = together.mapInArrow(lambda b: summed_cells(b, part_words), "block int, powers binary").toArrow()
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for block, powers in zip(found.column("block").to_pylist(), found.column("powers").to_pylist()):
        out[block] = np.frombuffer(powers, np.uint8)
    return out.ravel()


def stripes_of(batch: pa.RecordBatch, longest: int, powers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes of the words in some rows of text, with up to ``longest - 1`` next words."""
    words, word, piece, row = words_of(batch)
    if not len(word):
        return
    coded = pc.dictionary_encode(batch.column("lang"))
    langs, lang_of = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[row]
    linked = np.append(piece[1:] == piece[:-1], False)
    names = pa.concat_arrays([words, pa.array([END], words.type)])
    drawn = np.array([zlib.crc32(name) for name in names.cast(pa.binary()).to_pylist()], np.int64)
    # Where phrases start, which each is so far, its first word and what comes next.
    at = np.arange(len(word))
    codes, phrase = np.unique(lang_of * len(words) + word, return_inverse=True)
    first, part, nexts = np.arange(len(codes)), np.zeros(len(codes), np.int64), None
    found: list[tuple] = []
    for length in range(1, longest):
        inside = linked[at + length - 1]
        after = np.where(inside, word[np.minimum(at + length, len(word) - 1)], len(words))
        if length > 1:
            at, phrase, after, inside = at[inside], phrase[inside], after[inside], inside[inside]
        entries, place, counts = np.unique(
            phrase * len(names) + after, return_inverse=True, return_counts=True
        )
        before, after = entries // len(names), entries % len(names)
        own = names.take(pa.array(after))
        nexts = own if nexts is None else pc.binary_join_element_wise(nexts.take(pa.array(before)), own, "\t")
        first, part = first[before], part[before] * 31 + drawn[after]
        found.append((first, part, nexts, counts))
        # Entries are the phrases of the next round.
        at, phrase = at[inside], place[inside]
    first, part, counts = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3))
    part &= (1 << powers[cells_of(words)].astype(np.int64)[codes[first] % len(words)]) - 1
    order = np.lexsort((part, first))
    nexts = pa.concat_arrays([f[2] for f in found]).take(pa.array(order))
    lang, prefix = langs.take(pa.array(codes // len(words))), words.take(pa.array(codes % len(words)))
    yield from in_rows(striped(lang, prefix, first[order], part[order], nexts, counts[order]))


def text_stripes(batches: Iterator[pa.RecordBatch], longest: int, powers) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            yield from stripes_of(rows, longest, powers.value)


class Merged:
    """Entries of stripes summed elementwise, in the order of their prefixes."""

    def __init__(self, stripes: pa.Table):
        keys = pc.binary_join_element_wise(stripes["lang"], stripes["prefix"], "\t").combine_chunks()
        coded = pc.dictionary_encode(keys)
        row_owner = coded.indices.to_numpy().astype(np.int64)
        first = pa.array(np.unique(row_owner, return_index=True)[1])
        self.lang = stripes["lang"].combine_chunks().take(first)
        self.prefix = stripes["prefix"].combine_chunks().take(first)
        nexts = pc.split_pattern(stripes["nexts"].combine_chunks(), " ")
        counts = pc.list_flatten(pc.split_pattern(stripes["counts"].combine_chunks(), " "))
        names = pc.dictionary_encode(pc.list_flatten(nexts))
        size = max(len(names.dictionary), 1)
        codes = np.repeat(row_owner, pc.list_value_length(nexts).to_numpy()) * size + names.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        starts = starts_of(codes[order])
        self.counts = np.add.reduceat(counts.cast(pa.int64()).to_numpy()[order], starts)
        found = codes[order][starts]
        self.owner = found // size
        self.nexts = names.dictionary.take(pa.array(found % size))

    def but_last(self, last: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Owners, next words and counts of all prefixes but the last, or of that one."""
        chosen = (self.owner == len(self.prefix) - 1) == last
        return self.owner[chosen], self.nexts.filter(pa.array(chosen)), self.counts[chosen]

    def last_stripe(self) -> pa.RecordBatch:
        owner, nexts, counts = self.but_last(True)
        return striped(self.lang, self.prefix, owner, np.zeros(len(owner), np.int64), nexts, counts)

    def counted(self, last: bool, least: int) -> pa.RecordBatch:
        """Counts of words and of phrases with ``least`` occurrences, and for phrases
        the greatest count of a longer one that begins or ends with them."""
        owner, nexts, counts = self.but_last(last)
        more = pc.count_substring(nexts, "\t").to_numpy(zero_copy_only=False)
        sums = np.zeros(len(self.prefix), np.int64)
        np.add.at(sums, owner[more == 0], counts[more == 0])
        held = pa.array(np.flatnonzero(sums))
        kept = (counts >= least) & pc.not_equal(nexts, END).to_numpy(zero_copy_only=False)
        owner, nexts, counts, words = owner[kept], nexts.filter(pa.array(kept)), counts[kept], more[kept] + 2
        lang = self.lang.take(pa.array(owner))
        phrase = pc.binary_join_element_wise(
            self.prefix.take(pa.array(owner)), pc.replace_substring(nexts, "\t", " "), " "
        )
        long = pa.array(words > 2)
        around = [
            (lang.filter(long), pc.replace_substring_regex(phrase.filter(long), end, ""), words[words > 2] - 1, None, counts[words > 2])
            for end in ("^[^ ]+ ", " [^ ]+$")
        ]
        tables = [
            (self.lang.take(held), self.prefix.take(held), np.ones(len(held), np.int32), sums[sums > 0], None),
            (lang, phrase, words, counts, None),
            *around,
        ]
        return pa.Table.from_arrays(
            [
                pa.chunked_array([t[0] for t in tables], pa.string()),
                pa.chunked_array([t[1] for t in tables], pa.string()),
                pa.chunked_array([pa.array(t[2].astype(np.int32)) for t in tables]),
                *(
                    pa.chunked_array([
                        pa.nulls(len(t[0]), pa.int64()) if t[i] is None else pa.array(t[i], pa.int64())
                        for t in tables
                    ])
                    for i in (3, 4)
                ),
            ],
            ["lang", "phrase", "words", "n", "longer"],
        )


def merged_counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Merges sorted stripes; only the prefix that the next batch may continue is held."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        merged = Merged(pa.Table.from_batches([batch] if held is None else [held, batch]))
        yield from merged.counted(False, least).to_batches(max_chunksize=ROWS)
        held = merged.last_stripe()
    if held is not None:
        yield from Merged(pa.Table.from_batches([held])).counted(True, least).to_batches()


def phrase_counts(
    docs: DataFrame, longest: int = WORDS, least: int = LEAST, part_words: int = PART_WORDS
) -> DataFrame:
    """(lang, phrase, words, n, longer): counts of all words, and of longer phrases with
    ``least`` occurrences; ``longer`` is the greatest count of a phrase of one word more
    around it, among those that have as many."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    powers = docs.sparkSession.sparkContext.broadcast(part_powers(texts, part_words))
    stripes = texts.mapInArrow(lambda b: text_stripes(b, longest, powers), STRIPES)
    key = ["lang", "prefix", "part"]
    # Python sees one stripe after the other, so a task never holds more than one.
    together = stripes.repartition(*key).sortWithinPartitions(*key)
    counted = together.mapInArrow(lambda b: merged_counts(b, least), COUNTS)
    return counted.groupBy("lang", "phrase", "words").agg(
        F.sum("n").alias("n"), F.max("longer").alias("longer")
    )


def scored_cuts(counts: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases that no longer one subsumes."""
    known = counts.where(F.col("n") >= least)
    part = known.select("lang", "phrase", "n")
    left = part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    candidates = known.where(
        (F.col("words") > 1)
        & ~F.coalesce(
            F.col("longer").cast(EXACT) * 100 >= F.col("n").cast(EXACT) * subsumed, F.lit(False)
        )
    )
    cuts = candidates.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k")
    )
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    joined = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    square = F.lit(SCALE).cast("decimal(7,0)") * exact["a"] * exact["a"]
    scored = joined.select(
        "lang", "phrase", "a", "k", "l", "r", square.alias("square"), (exact["l"] * exact["r"]).alias("product")
    ).withColumn("score", F.expr("square div product"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return scored.groupBy("lang", "phrase", "a").agg(lowest).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Adds ``rank`` and keeps the first ``top`` rows of each language.

    A language with very many phrases is first ranked in groups of about ``GROUP`` rows,
    of which the first ``top`` rows go on, until one group is left.
    """
    groups = max(-(-scored.count() // GROUP), 1)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    while True:
        group: list[Column] = [F.col("lang")]
        if groups > 1:
            group.append(F.pmod(F.xxhash64(F.lit(groups), "phrase"), F.lit(groups)))
        place = F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint")
        best = scored.withColumn("rank", place).where(F.col("rank") <= top)
        if groups == 1:
            return best
        scored = materialise(best.drop("rank"), "collocation-ranks")
        groups = min(-(-groups * top // GROUP), groups - 1)


def collocations(
    docs: DataFrame,
    longest: int = WORDS,
    least: int = LEAST,
    subsumed: int = SUBSUMED,
    top: int = TOP,
) -> DataFrame:
    """Per language the phrases of 2 to ``longest`` words of highest scores."""
    if longest < 2:
        raise ValueError("phrases have two words at least")
    counts = materialise(phrase_counts(docs, longest, least), "collocation-counts")
    sizes = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    scored = materialise(scored_cuts(counts, least, subsumed), "collocation-scores")
    return ranked(scored, top).join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
