"""Groups spelling variants by an index of variable-length grams.

Words are counted over all documents. A dictionary of grams of 2 to ``LONGEST`` code
points is built from the words: a gram is extended by one code point only where it is
frequent, so rare beginnings stay short. A word is decomposed into the longest
dictionary gram at each place, without those that lie inside the one before.

From the dictionary follows which single edits of its word can affect a gram: those
from ``safe`` to ``reach``. An edit behind the reach of a gram leaves it and all before
it, so their lists merge into one, keyed by what they cover from the start; an edit
before ``safe`` leaves all from that gram on, keyed by what they cover to the end. A
word takes a gram at its middle: edits behind it and before it leave merged lists of
about two thirds of the word each, and those that affect it leave the grams of both
ends, whose lists merge into a third. Where no three grams are far enough apart, two
that no single edit affects together do. Words that meet in a list are verified by
their edit distance.

A pair of words is looked up from the shorter one. Words of n code points are indexed
for words of n and of n - 1 code points, so lists are kept apart by length and place.
Lists are named by 64-bit hashes; a collision costs a verification and nothing else.

Defined results: null texts and texts without a letter hold no run, and so no word. A
null doc_id counts as an empty one in the hash. Repeated rows count each time. Ties of
n go to the least word. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.session import materialise

# [A-Za-zÀ-ÿ]+ in UTF-8, after A-Z were lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
SHORTEST = 6
LEAST = 5
TYPO_EVERY = 199
TIMES = 5
# Grams: a gram is extended where it has this share of all pairs of neighbouring code
# points. Of each length at most 1 / SHARE grams are frequent and extended by at most
# the 90 code points of words and the end, so the dictionary has a fixed upper bound.
LONGEST = 6
SHARE = 1 / 2000
START, END = "<", ">"
# Entries a task holds before it hands its counts on.
HELD = 200_000
WORDS_A_TASK = 20_000


def flushed(counts: Counter, name: str) -> pa.RecordBatch:
    names = list(counts)
    if names and isinstance(names[0], bytes):
        words = pa.array(names, pa.binary()).cast(pa.string())
    else:
        words = pa.array(names, pa.string())
    return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], [name, "n"])


def counted_words(
    batches: Iterator[pa.RecordBatch], shortest: int, typo_every: int
) -> Iterator[pa.RecordBatch]:
    """Lower-cased runs of enough code points, after the planted deletions, and counts."""
    counts: Counter = Counter()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
            if not text.is_valid:
                continue
            begun = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in Counter(RUN.findall(text.as_py().lower())).items():
                size = len(run) - run.count(b"\xc3")
                if size < shortest:
                    continue
                hashed = zlib.crc32(run, begun)
                if hashed % typo_every == 0:
                    if size == shortest:
                        continue
                    points = run.decode()
                    place = hashed % size
                    run = (points[:place] + points[place + 1 :]).encode()
                counts[run] += n
            if len(counts) > HELD:
                yield flushed(counts, "word")
                counts.clear()
    yield flushed(counts, "word")


def vocabulary(
    docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, typo_every: int = TYPO_EVERY
) -> DataFrame:
    """(word, n) of all words of at least so many code points and occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(
        lambda b: counted_words(b, shortest, typo_every), "word string, n bigint"
    )
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def counted_grams(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """The grams of 2 to ``longest`` code points of padded words."""
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            padded = START + word + END
            for size in range(2, longest + 1):
                counts.update(padded[i : i + size] for i in range(len(padded) - size + 1))
            if len(counts) > HELD:
                yield flushed(counts, "gram")
                counts.clear()
    yield flushed(counts, "gram")


class Dictionary:
    """Grams with their counts, and those of them that have longer ones."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.inner = {gram[:-1] for gram in counts if len(gram) > 2}

    def decompose(self, padded: str, longest: int) -> list[tuple[int, int, int, int]]:
        """(start, end, reach, safe) of the grams of a padded word. An edit at a place
        beyond ``reach`` or before ``safe`` leaves the gram as it is."""
        found, reach, covered = [], 0, 0
        for start in range(len(padded) - 1):
            end = start + 2
            while end - start < longest and end < len(padded) and padded[start : end + 1] in self.counts:
                end += 1
            # Another code point at the end could make the gram longer.
            open_end = end - start < longest and padded[start:end] in self.inner
            reach = max(reach, end if open_end else end - 1)
            if end > covered:
                covered = end
                found.append((start, end, reach, min(start, end - longest)))
        return found


class Lists:
    """Names of the merged lists of words that are looked up with ``length`` code points.

    ``reach`` counts from the start and ``safe`` from the end of a word, so that an edit
    between two grams changes neither. Grams overlap or touch, so from one to the next
    both rise by less than twice ``longest``: a window of four times that around the
    middle holds every gram that ``asked`` can choose, however long a word is.
    """

    def __init__(self, length: int, dictionary: Dictionary, longest: int):
        self.length, self.dictionary = length, dictionary
        self.longest = max(min(length // 3, longest), 2)
        self.middle = (length + 2) // 2
        self.window = 4 * self.longest

    def grams(self, padded: str) -> tuple[list[tuple[int, int, int]], int]:
        """(place, reach, safe) near the middle, and by how much the word is longer."""
        longer = len(padded) - self.length - 2
        found = [
            (place, reach, safe)
            for place, (_, _, reach, safe) in enumerate(self.dictionary.decompose(padded, self.longest))
            if reach >= self.middle - self.window and safe - longer <= self.middle + self.window
        ]
        return found, longer

    def before(self, padded: str, reach: int) -> int:
        return xxhash.xxh64_intdigest(f"{self.length}<{padded[:reach + 1]}")

    def behind(self, padded: str, safe: int) -> int:
        return xxhash.xxh64_intdigest(f"{self.length}>{padded[max(safe, 0):]}")

    def around(self, padded: str, reach: int, safe: int) -> int:
        return xxhash.xxh64_intdigest(f"{self.length}|{padded[:reach + 1]}|{padded[safe:]}")

    def held(self, padded: str) -> set[int]:
        """The lists that hold the word."""
        grams, longer = self.grams(padded)
        reaches = {reach for _, reach, _ in grams}
        safes = {safe for _, _, safe in grams}
        names = {self.before(padded, reach) for reach in reaches}
        names |= {self.behind(padded, safe) for safe in safes}
        for reach in reaches:
            if reach < self.middle:
                names.update(
                    self.around(padded, reach, safe) for safe in safes if safe - longer > self.middle
                )
        return names

    def asked(self, padded: str) -> set[int]:
        """The lists in which any word of one edit must be: at least one of them."""
        grams, _ = self.grams(padded)
        for _, reach, safe in grams:
            if safe <= self.middle <= reach:
                left = max((r for _, r, _ in grams if r < safe), default=None)
                right = min((s for _, _, s in grams if s > reach), default=None)
                if left is not None and right is not None:
                    return {
                        self.before(padded, reach), self.behind(padded, safe),
                        self.around(padded, left, right),
                    }
        pairs = [
            (abs(self.middle - reach), reach, min(s for _, _, s in grams if s > reach))
            for _, reach, _ in grams
            if any(s > reach for _, _, s in grams)
        ]
        _, reach, safe = min(pairs)
        return {self.before(padded, reach), self.behind(padded, safe)}


def keyed_words(
    batches: Iterator[pa.RecordBatch], dictionary, longest: int, shortest: int
) -> Iterator[pa.RecordBatch]:
    """Each word under the lists that hold it and under those that it asks."""
    lists: dict[int, Lists] = {}

    def of(length: int) -> Lists:
        if length not in lists:
            lists[length] = Lists(length, dictionary.value, longest)
        return lists[length]

    for batch in batches:
        names, sizes, asks = [], [], []
        for word in batch.column("word").to_pylist():
            padded, size = START + word + END, len(word)
            held = of(size).held(padded)
            if size > shortest:
                held |= of(size - 1).held(padded)
            asked = of(size).asked(padded)
            names += held
            names += asked
            sizes.append(len(held) + len(asked))
            asks += [False] * len(held) + [True] * len(asked)
        rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(names, np.uint64).view(np.int64)),
                batch.column("word").take(rows), batch.column("n").take(rows),
                pa.array(asks, pa.bool_()),
            ],
            ["list", "word", "n", "asks"],
        )
        for at in range(0, len(names), 50_000):
            yield out.slice(at, 50_000)


def gram_dictionary(words: DataFrame, longest: int = LONGEST, share: float = SHARE) -> Dictionary:
    """Grams whose beginnings are frequent; all of two code points."""
    grams = materialise(
        words.select("word").mapInArrow(lambda b: counted_grams(b, longest), "gram string, n bigint")
        .groupBy("gram").agg(F.sum("n").alias("n")),
        "spelling-grams",
    )
    size = F.length("gram")
    total = grams.agg(F.sum(F.when(size == 2, F.col("n")))).first()[0] or 0
    frequent = grams.where((F.col("n") >= total * share) & (size < longest)).select(
        F.col("gram").alias("beginning")
    )
    # At most 1 / share grams of each length: a bounded broadcast.
    longer = grams.where(size > 2).join(
        F.broadcast(frequent), F.col("gram").substr(F.lit(1), size - 1) == F.col("beginning"), "left_semi"
    )
    kept = grams.where(size == 2).unionByName(longer).toArrow()
    return Dictionary(dict(zip(kept.column("gram").to_pylist(), kept.column("n").to_pylist())))


def near_words(
    words: DataFrame, longest: int = LONGEST, share: float = SHARE, shortest: int = SHORTEST
) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words (word, n) one edit apart, once."""
    dictionary = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, longest, share))
    # A word is in some sixty lists: tasks are made by what they write, not by what they read.
    tasks = max(-(-words.count() // WORDS_A_TASK), 1)
    keyed = materialise(
        words.repartition(tasks).mapInArrow(
            lambda b: keyed_words(b, dictionary, longest, shortest),
            "list bigint, word string, n bigint, asks boolean",
        ),
        "spelling-lists",
    )
    asking = keyed.where("asks").select("list", F.col("word").alias("a"), F.col("n").alias("n_a"))
    listed = keyed.where("not asks").select("list", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = asking.join(listed, "list").where(
        ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, the last word that forms lead to.

    Forms have more occurrences than their words, so no path returns; paths are
    doubled each round until none goes on.
    """
    current = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(
            current.join(further, "root", "left").select(
                "word",
                F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            ),
            "spelling-roots",
        )
        current = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return current


def spelling_variants(
    docs: DataFrame,
    shortest: int = SHORTEST,
    least: int = LEAST,
    times: int = TIMES,
    typo_every: int = TYPO_EVERY,
    longest: int = LONGEST,
    share: float = SHARE,
) -> DataFrame:
    """Per word: its near word of most occurrences if that has ``times`` as many."""
    if shortest < 4:
        raise ValueError("words of fewer than 4 code points have no such pair of grams")
    words = materialise(vocabulary(docs, shortest, least, typo_every), "spelling-words")
    pairs = near_words(words, longest, share, shortest)
    a, b = F.col("a"), F.col("b")
    both = pairs.select(
        F.inline(
            F.array(
                F.struct(a.alias("word"), b.alias("other"), F.col("n_b").alias("n_other")),
                F.struct(b.alias("word"), a.alias("other"), F.col("n_a").alias("n_other")),
            )
        )
    )
    best = F.min(F.struct((-F.col("n_other")).alias("rank"), "other"))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left")
    enough = -F.col("best.rank") >= times * F.col("n")
    judged = materialise(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.other")).alias("form"),
            F.when(enough, -F.col("best.rank")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = roots_of(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
