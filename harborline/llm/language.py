"""Identifies languages word first.

A word that the labelled texts hold is scored by its log frequency in each
language. For any other word the model backs off to character n-grams of the
padded word, the longest first, and stops at the first length of which any is
known. A text's score per language is the sum over its words.

The model is fitted on a bounded sample: about ``SAMPLE`` labelled documents of each
language, chosen by a hash of the doc_id. Every language is learned: where there are so
many that the sample would exceed ``TOTAL`` documents, each has fewer, but one at least.
Everything else covers all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from. Rows without a language, a text
or a doc_id are not learned from. Equal scores go to the first language in code
point order. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import held_out
from harborline.session import materialise

SAMPLE = 500
TOTAL = 500_000
LONGEST = 5
# Words and n-grams of fewer documents of the sample are left to the shorter n-grams.
MIN_DOCS = 3
BACKOFF = 0.4
LETTERS = re.compile(r"[^\W\d_]+")
# Words whose scores are kept, and numbers these may take up.
CACHE = 200_000
CACHE_CELLS = 8_000_000
# Texts whose unseen words are scored together.
TOGETHER = 32


def grams(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def sample_rows(docs: DataFrame, per_language: int, total: int = TOTAL) -> DataFrame:
    """About ``per_language`` labelled rows of each language (all of a smaller one), fewer
    if all languages together had more than ``total``, and of each that of least hash."""
    labelled = docs.where(
        F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & ~held_out(F.col("doc_id"))
    ).select("doc_id", "lang", "text")
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = materialise(
        labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min(draw).alias("least")),
        "language-sizes",
    )
    share = min(per_language, total / max(sizes.count(), 1))
    # One row per language.
    return (
        labelled.join(F.broadcast(sizes), "lang")
        .where((draw * F.col("rows") < share) | (draw == F.col("least")))
        .select("lang", "text")
    )


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's words: language, word and how often."""
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = Counter(LETTERS.findall(text.lower()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(words), pa.string()),
                    pa.array(list(words), pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                ["lang", "word", "n"],
            )


class Logs:
    """Log frequencies per language of the pieces of one size. A language that does not
    hold a piece has that of half an occurrence, so only the others are stored."""

    def __init__(self, entries: list[list[tuple[int, int]]], languages: int):
        self.starts = np.concatenate([[0], np.cumsum([len(entry) for entry in entries])]).astype(np.int64)
        self.places = np.array([place for entry in entries for place, _ in entry], np.int64)
        counts = np.array([n for entry in entries for _, n in entry], np.float64)
        sums = 0.5 * len(entries) + np.bincount(self.places, counts, languages)
        self.least = np.log(0.5) - np.log(np.maximum(sums, 0.5))
        self.more = np.log(counts + 0.5) - np.log(0.5)

    def table(self) -> np.ndarray:
        """All log frequencies, a row per piece."""
        size = len(self.starts) - 1
        out = np.tile(self.least, (size, 1))
        out[np.repeat(np.arange(size), np.diff(self.starts)), self.places] += self.more
        return out

    def means(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean log frequencies of consecutive runs of pieces, one per start."""
        sizes = np.diff(np.append(starts, len(rows)))
        out = np.tile(self.least, (len(starts), 1))
        entries = self.starts[rows + 1] - self.starts[rows]
        places = np.repeat(self.starts[rows + 1] - np.cumsum(entries), entries) + np.arange(entries.sum())
        run = np.repeat(np.repeat(np.arange(len(starts)), sizes), entries)
        np.add.at(out, (run, self.places[places]), self.more[places] / sizes[run])
        return out


class Model:
    """Log frequencies per language of words (size 0) and n-grams, a table per size."""

    def __init__(self, languages: list[str], names: list[list[str]], logs: list[Logs]):
        self.languages, self.names, self.logs = languages, names, logs


def fit(docs: DataFrame, per_language: int = SAMPLE, min_docs: int = MIN_DOCS) -> Model:
    """Counts the sample in Spark; the driver gets what the bounded sample holds."""
    counted = sample_rows(docs, per_language).mapInArrow(
        count_partition, "lang string, word string, n bigint"
    )
    words = materialise(
        counted.groupBy("lang", "word").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")
        ),
        "language-words",
    )
    padded = words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"), "lang", "n", "docs")
    pieces = F.expr(
        f"flatten(transform(sequence(1, least({LONGEST}, length(padded))), "
        "g -> transform(sequence(1, length(padded) - g + 1), "
        "i -> named_struct('size', g, 'piece', substring(padded, i, g)))))"
    )
    both = (
        padded.select("lang", "n", "docs", F.inline(pieces))
        .unionByName(words.select("lang", "n", "docs", F.lit(0).alias("size"), F.col("word").alias("piece")))
    )
    by_piece = (
        both.groupBy("size", "piece", "lang")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("size", "piece")
        .agg(
            F.sum("docs").alias("docs"),
            F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"),
        )
        .where(F.col("docs") >= min_docs)
        .select("size", "piece", "n")
    )
    rows = by_piece.toArrow()
    sizes = rows.column("size").to_numpy()
    names = rows.column("piece").to_pylist()
    counts = rows.column("n").to_pylist()
    languages = sorted({lang for entry in counts for lang, _ in entry})
    place = {lang: i for i, lang in enumerate(languages)}
    by_size, logs = [], []
    for size in range(LONGEST + 1):
        rows_of = np.flatnonzero(sizes == size)
        by_size.append([names[row] for row in rows_of])
        logs.append(Logs([[(place[lang], n) for lang, n in counts[row]] for row in rows_of], len(languages)))
    return Model(languages, by_size, logs)


class Scores(dict):
    """Row numbers of words in a table of scores; the oldest words make room for new ones."""

    def __init__(self, model: Model):
        self.model = model
        self.known = [{name: row for row, name in enumerate(names)} for names in model.names]
        languages = max(len(model.languages), 1)
        # Few languages: whole tables, which one gather reads.
        cells = sum(map(len, model.names)) * languages
        self.tables = [logs.table() for logs in model.logs] if cells <= CACHE_CELLS else None
        self.cache = max(min(CACHE, CACHE_CELLS // languages), 1)
        self.rows = np.zeros((min(1024, self.cache), len(model.languages)))

    def pieces(self, word: str) -> tuple[int, list[int]]:
        """The longest size of which any piece of the word is known, and those pieces."""
        row = self.known[0].get(word)
        if row is not None:
            return 0, [row]
        for size in range(LONGEST, 0, -1):
            known = self.known[size]
            found = [known[piece] for piece in grams(word, size) if piece in known]
            if found:
                return size, found
        return -1, []

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of words in each language, all words of a size at once."""
        out = np.zeros((len(words), len(self.model.languages)))
        by_size: dict[int, tuple[list, list, list]] = {}
        for place, word in enumerate(words):
            size, found = self.pieces(word)
            if found:
                places, rows, starts = by_size.setdefault(size, ([], [], []))
                places.append(place)
                starts.append(len(rows))
                rows += found
        for size, (places, rows, starts) in by_size.items():
            rows, starts = np.array(rows, np.int64), np.array(starts, np.int64)
            if self.tables is None:
                means = self.model.logs[size].means(rows, starts)
            else:
                sizes = np.diff(np.append(starts, len(rows)))
                means = np.add.reduceat(self.tables[size][rows], starts) / sizes[:, None]
            back = LONGEST - size + 1 if size else 0
            out[places] = means + back * np.log(BACKOFF)
        return out

    def learn(self, words: list[str]) -> None:
        """Adds words that are not held, at most half of what the cache holds."""
        if len(self) + len(words) > self.cache:
            kept = list(self)[-(self.cache - self.cache // 2) :] if self.cache > 1 else []
            kept = kept[len(words) + len(kept) - self.cache :] if len(words) + len(kept) > self.cache else kept
            self.rows[: len(kept)] = self.rows[[self[word] for word in kept]]
            self.clear()
            self.update(zip(kept, range(len(kept))))
        while len(self) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        at = len(self)
        self.rows[at : at + len(words)] = self.score(words)
        self.update(zip(words, range(at, at + len(words))))

    def total(self, words: list[str]) -> np.ndarray:
        found = np.zeros(len(self.model.languages))
        step = max(self.cache // 2, 1)
        for at in range(0, len(words), step):
            part = words[at : at + step]
            new = list({word: None for word in part if word not in self})
            if new:
                self.learn(new)
                # What made room may be of this part itself.
                new = list({word: None for word in part if word not in self})
                if new:
                    self.clear()
                    self.learn(list(dict.fromkeys(part)))
            places = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            found += self.rows[places].sum(axis=0)
        return found


def words_in(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def predict(words: list[str], scores: Scores) -> tuple[str, float]:
    if not words or not scores.model.languages:
        return "und", 0.0
    total = scores.total(words)
    best = int(np.argmax(total))
    return scores.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict_partition(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    scores = Scores(model.value)
    for batch in batches:
        found = []
        for at in range(0, batch.num_rows, TOGETHER):
            words = [words_in(t.as_py()) for t in batch.column("text").slice(at, TOGETHER)]
            new = list({word: None for text in words for word in text if word not in scores})
            # The unseen words of some texts are scored together, where they fit.
            if 2 * len(new) <= scores.cache:
                scores.learn(new)
            found += [predict(text, scores) for text in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def identify(docs: DataFrame, per_language: int = SAMPLE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document: held_out, lang_pred and the probability of that language."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_language, min_docs))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    )
    return rows.mapInArrow(
        lambda b: predict_partition(b, model),
        "doc_id bigint, held_out boolean, lang_pred string, score double",
    )
