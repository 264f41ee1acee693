"""Classifies document quality by histogram gradient-boosted trees.

Each document is described by statistics of its whole text: shares of kinds of
characters, sizes and repetition of words and lines, and how well it compresses. The
trees are fitted in numpy on the statistics of a bounded sample of labelled documents:
values are sorted into at most ``BINS`` bins by quantiles, each level of a tree sums
gradients per node, statistic and bin, and the best split of every node follows from
running sums over the bins. All trees are then flattened into arrays of nodes, through
which a batch of documents moves level by level.

The sample holds about ``SAMPLE`` labelled documents of each class, chosen by a hash of
the doc_id, or all of a smaller class; a class that was thinned out weighs
accordingly more. Everything else covers all rows.

Defined results: null and empty texts have statistics of 0 and the score that the
trees give them. Labels that are null or other than 0 and 1, without a doc_id, or of a
document that does not exist teach nothing. With labels of one class only, every score
is that class; without labels, 0.5. Equal splits go to the first statistic and bin.
Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import held_out

SAMPLE = 10_000
THRESHOLD = 0.5
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
RIDGE = 1.0
LEAST_ROWS = 5

STATISTICS = [
    "log_bytes", "log_words", "letters", "capitals", "digits", "spaces", "marks", "symbols",
    "most_frequent_mark", "other_bytes", "byte_entropy", "word_length", "long_words",
    "capital_words", "marked_words", "lone_marks", "different_words", "most_frequent_word",
    "repeated_neighbours", "log_lines", "line_length", "empty_lines", "repeated_lines",
    "compressed",
]

_KIND = np.zeros(256, np.int64)
for _kind, _chars in enumerate(
    [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\x0b\f\r", b".,;:!?'\"()-"], 1
):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 6
LOWER, CAPITAL, DIGIT, SPACE, MARK, OTHER_BYTE, SYMBOL = 1, 2, 3, 4, 5, 6, 0


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATISTICS``."""
    data = (text or "").encode()
    if not data:
        return [0.0] * len(STATISTICS)
    size = len(data)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by_kind = np.bincount(_KIND, by_byte, 7) / size
    shares = by_byte[by_byte > 0] / size
    words = data.split()
    n = max(len(words), 1)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = data.split(b"\n")
    marks = by_byte[(_KIND == SYMBOL) | (_KIND == MARK)]
    return [
        float(np.log1p(size)),
        float(np.log1p(len(words))),
        by_kind[LOWER] + by_kind[CAPITAL] + by_kind[OTHER_BYTE],
        by_kind[CAPITAL],
        by_kind[DIGIT],
        by_kind[SPACE],
        by_kind[MARK],
        by_kind[SYMBOL],
        float(marks.max()) / size,
        by_kind[OTHER_BYTE],
        float(-(shares * np.log2(shares)).sum()),
        float(lengths.sum()) / n,
        float((lengths > 12).sum()) / n,
        sum(map(bytes.isupper, words)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(len(w) < 3 and not w.isalnum() and w[0] < 128 for w in words) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(np.log1p(len(lines))),
        len(words) / len(lines),
        sum(not line.strip() for line in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        len(zlib.compress(data, 1)) / size,
    ]


class Trees:
    """Nodes of all trees in arrays. A row goes to ``left`` where its statistic is at
    most the threshold; leaves lead to themselves."""

    def __init__(self, base: float):
        self.base = base
        self.statistic: list[int] | np.ndarray = []
        self.threshold: list[float] | np.ndarray = []
        self.left: list[int] | np.ndarray = []
        self.right: list[int] | np.ndarray = []
        self.value: list[float] | np.ndarray = []
        self.roots: list[int] | np.ndarray = []
        self.depth = 0

    def add_leaf(self) -> int:
        node = len(self.value)
        for column, item in (
            (self.statistic, 0), (self.threshold, np.inf), (self.left, node), (self.right, node), (self.value, 0.0)
        ):
            column.append(item)
        return node

    def flattened(self) -> Trees:
        kinds = {"statistic": np.int32, "left": np.int32, "right": np.int32, "roots": np.int32,
                 "threshold": np.float64, "value": np.float64}
        for name, kind in kinds.items():
            setattr(self, name, np.array(getattr(self, name), kind))
        return self

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row reaches, all trees at once."""
        total = np.full(len(rows), self.base)
        if not len(self.roots):
            return total
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        place = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            low = rows[place, self.statistic[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return total + self.value[at].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(rows)))


def edges_of(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper limits of all bins but the last: values that part it into equal shares."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
    else:
        values = values[:-1]
    return values


def best_splits(
    gradients: np.ndarray, curvatures: np.ndarray, rows: np.ndarray, ridge: float, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the gain, statistic and bin of its best split, from histograms of
    the form (node, statistic, bin)."""
    sums = [np.cumsum(h, axis=2) for h in (gradients, curvatures, rows)]
    whole = [s[:, :, -1:] for s in sums]

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + ridge)

    gain = (
        worth(sums[0], sums[1]) + worth(whole[0] - sums[0], whole[1] - sums[1]) - worth(whole[0], whole[1])
    )
    allowed = (sums[2] >= least) & (whole[2] - sums[2] >= least)
    gain = np.where(allowed, gain, -np.inf).reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    bins = gradients.shape[2]
    return gain[np.arange(len(gain)), best], best // bins, best % bins


def boost(
    features: np.ndarray,
    labels: np.ndarray,
    weights: np.ndarray,
    trees: int = TREES,
    depth: int = DEPTH,
    rate: float = RATE,
    bins: int = BINS,
    ridge: float = RIDGE,
    least: int = LEAST_ROWS,
) -> Trees:
    """Trees for the log odds of label 1, by Newton steps on the logistic loss."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    if not 0 < share < 1:
        return Trees(np.log((share + 1e-9) / (1 - share + 1e-9))).flattened()
    model = Trees(float(np.log(share / (1 - share))))
    n, columns = features.shape
    edges = [edges_of(features[:, c], bins) for c in range(columns)]
    binned = np.stack([np.searchsorted(e, features[:, c], "left") for c, e in enumerate(edges)], axis=1)
    column_bins = np.arange(columns) * bins + binned
    raw = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weights * (labels - p), weights * p * (1 - p)
        root = model.add_leaf()
        model.roots.append(root)
        node = np.zeros(n, np.int64)  # place in ``open_nodes``, or -1
        leaf = np.full(n, root)
        open_nodes = [root]
        for level in range(depth):
            rows = np.flatnonzero(node >= 0)
            if not len(rows):
                break
            cells = (node[rows, None] * columns * bins + column_bins[rows]).ravel()
            shape = (len(open_nodes), columns, bins)

            def histogram(values: np.ndarray | None) -> np.ndarray:
                held = None if values is None else np.repeat(values[rows], columns)
                return np.bincount(cells, held, int(np.prod(shape))).reshape(shape)

            gain, column, bin_ = best_splits(histogram(g), histogram(h), histogram(None), ridge, least)
            following, lefts = [], np.full(len(open_nodes), -1)
            for place, parent in enumerate(open_nodes):
                if gain[place] > 1e-9:
                    lefts[place] = len(following)
                    model.statistic[parent] = int(column[place])
                    model.threshold[parent] = float(edges[column[place]][bin_[place]])
                    model.left[parent], model.right[parent] = model.add_leaf(), model.add_leaf()
                    following += [model.left[parent], model.right[parent]]
                    model.depth = max(model.depth, level + 1)
            own = node[rows]
            low = binned[rows, column[own]] <= bin_[own]
            node[rows] = np.where(lefts[own] < 0, -1, lefts[own] + ~low)
            open_nodes = following
            split = rows[node[rows] >= 0]
            leaf[split] = np.array(following, np.int64)[node[split]] if following else leaf[split]
        top = np.bincount(leaf, g, len(model.value))
        bottom = np.bincount(leaf, h, len(model.value))
        for reached in np.unique(leaf):
            model.value[reached] = float(rate * top[reached] / (bottom[reached] + ridge))
        raw += np.array(model.value)[leaf]
    return model.flattened()


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, quality) of about ``per_class`` labelled documents of each class, and how
    many labels each class has."""
    known = labels.where(
        F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("quality") == 1, per_class / max(counts.get(1, 0), 1)).otherwise(
        per_class / max(counts.get(0, 0), 1)
    )
    # About 2 * per_class rows of two numbers, whatever the input: a bounded broadcast.
    chosen = F.broadcast(known.where(draw < rate).distinct())
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality"), counts


def statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column("text")]
        columns = [pa.array([row[i] for row in rows], pa.float64()) for i in range(len(STATISTICS))]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *columns], ["quality", *STATISTICS])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, **options) -> Trees:
    """Trees fitted on the driver, which gets the numbers of the bounded sample."""
    sample, counts = sample_rows(docs, labels, per_class)
    schema = ", ".join(["quality int", *(f"{name} double" for name in STATISTICS)])
    found = sample.mapInArrow(statistic_rows, schema).toArrow()
    features = np.column_stack([found.column(name).to_numpy() for name in STATISTICS])
    known = found.column("quality").to_numpy()
    order = np.lexsort([*features.T[::-1], known])
    features, known = features[order], known[order].astype(np.float64)
    thinned = {label: max(counts.get(label, 0) / per_class, 1.0) for label in (0, 1)}
    weights = np.where(known == 1, thinned[1], thinned[0])
    return boost(features, known, weights / weights.mean() if len(weights) else weights, **options)


def score_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py()) for t in batch.column("text")])
        scores = model.value.score(rows.reshape(-1, len(STATISTICS)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "score"],
        )


def quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, **options) -> DataFrame:
    """Per document: held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class, **options))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    found = rows.mapInArrow(
        lambda b: score_rows(b, model), "doc_id bigint, held_out boolean, score double"
    )
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
