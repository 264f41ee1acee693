"""Finds personal data: base patterns, and a character model that adds spans.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by
fixed patterns. The model reads characters with an LSTM in both directions and
labels them with a CRF; it is trained in numpy on windows of the input labelled with
their base spans, and on as many as ``VARIANTS`` copies of each sampled text in which
the base spans are rewritten as the patterns do not know them: phones without plus sign
or country code or cut to 7 to 9 digits, cards parted by dots or strokes, IP addresses and e-mails with blanks
around their marks. Other digits of the input teach "outside" as they are, so account or
serial numbers stay out. A span of the model must be plausible: a card passes Luhn, a
phone has 7 to 15 digits, and none but an e-mail touches
a letter or digit outside. Texts are cut into overlapping windows. A window without a digit
or an at sign holds none of the four kinds and is not decoded, unless a span of the
window beside it runs on into it. Spans that window edges cut are joined where those of
neighbouring windows overlap and agree in kind. The spans of all windows of a text are
reconciled: base spans stay, then the surest go first.

The model is fitted on a bounded sample, about ``SAMPLE`` documents with a digit or an
at sign by a hash of the doc_id, and of their windows at most ``TRAINED``. Everything
else covers all rows.

Defined results: a null text is an empty one and has no span. A table without
documents to learn from gives base spans only. Repeated rows get equal results.
Positions are code points. Other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 1500
TRAINED = 3000
VARIANTS = 2
LENGTH = 96
STRIDE = 48
HIDDEN = 24
EMBEDDED = 8
EPOCHS = 10
BATCH = 64
SURE = 0.5
SEED = 8

TRIGGER = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns take all digits they meet, so a match cannot start inside a number.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the e-mail pattern, found from their at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of start, then of kind."""
    if not TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.groups()):
            found.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        digits = [int(c) for c in match[0] if c not in " -"]
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(match[0])) <= 15:
            found.append((match.start(), 3, match.end()))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    places = np.array([m.start() for m in TRIGGER.finditer(text)], np.int64)
    if not len(places):
        return []
    last = places // STRIDE
    return (np.unique(np.concatenate([last, np.maximum(last - 1, 0)])) * STRIDE).tolist()


def codes(text: str) -> np.ndarray:
    """Symbols of characters: ASCII as it is, 128 other letters, 129 others, 130 padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    wide = np.flatnonzero(points > 127)
    points[wide] = [128 if chr(p).isalpha() else 129 for p in points[wide].tolist()]
    return np.pad(points, (0, LENGTH - len(points)), constant_values=130)


SYMBOLS = 131
TAGS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind


def tags(spans: list[tuple[str, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, start, end in spans:
        if not out[start:end].any():
            label = 1 + 2 * KINDS.index(kind)
            out[start] = label
            out[start + 1 : end] = label + 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """An LSTM in both directions under a CRF, in numpy."""

    def __init__(self, seed: int = SEED):
        draw = np.random.default_rng(seed)
        scale = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"embed": scale(SYMBOLS, EMBEDDED), "out": scale(2 * HIDDEN, TAGS),
                  "out_bias": np.zeros(TAGS, np.float32), "move": scale(TAGS, TAGS)}
        for way in ("f", "b"):
            self.p[f"x{way}"] = scale(EMBEDDED, 4 * HIDDEN)
            self.p[f"h{way}"] = scale(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
            self.p[f"g{way}"] = bias

    def run(self, way: str, inputs: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; inputs are (steps, batch, gates)."""
        steps, batch, _ = inputs.shape
        h = np.zeros((batch, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        order = range(steps) if way == "f" else range(steps - 1, -1, -1)
        weights = self.p[f"h{way}"]
        for t in order:
            z = inputs[t] + h @ weights
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = (gates[:, n * HIDDEN : (n + 1) * HIDDEN] for n in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * before + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, squashed, h_before))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (steps, batch, tags) of symbols (batch, steps)."""
        states = []
        for way in ("f", "b"):
            table = self.p["embed"] @ self.p[f"x{way}"] + self.p[f"g{way}"]
            kept = None if keep is None else keep.setdefault(way, [])
            states.append(self.run(way, table[x.T], kept))
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.p["out"] + self.p["out_bias"]

    def crf_slopes(self, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the negative log likelihood by scores and by transitions."""
        steps, batch, _ = scores.shape
        move = self.p["move"]
        ahead = np.empty_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = scores[t] + log_sum(ahead[t - 1][:, :, None] + move[None], 1)
        behind = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            behind[t] = log_sum(move[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        total = log_sum(ahead[-1], 1)
        by_score = np.exp(ahead + behind - total[None, :, None])
        by_move = np.zeros_like(move)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + move[None] + (scores[t] + behind[t])[:, None, :]
            by_move += np.exp(pair - total[:, None, None]).sum(axis=0)
        rows = np.arange(batch)
        for t in range(steps):
            by_score[t, rows, y[:, t]] -= 1
            if t:
                np.add.at(by_move, (y[:, t - 1], y[:, t]), -1)
        return by_score / batch, by_move / batch

    def slopes(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict = {}
        scores = self.emissions(x, kept)
        by_score, by_move = self.crf_slopes(scores, y)
        flat = by_score.reshape(-1, TAGS)
        found = {"move": by_move, "out_bias": flat.sum(axis=0),
                 "out": kept["both"].reshape(-1, 2 * HIDDEN).T @ flat,
                 "embed": np.zeros_like(self.p["embed"])}
        by_both = by_score @ self.p["out"].T
        embedded = self.p["embed"][x.T]
        for side, way in enumerate(("f", "b")):
            by_state = by_both[:, :, side * HIDDEN : (side + 1) * HIDDEN]
            by_input = np.zeros((*x.T.shape, 4 * HIDDEN), np.float32)
            weights, by_weights = self.p[f"h{way}"], np.zeros_like(self.p[f"h{way}"])
            h_next = np.zeros((len(x), HIDDEN), np.float32)
            c_next = np.zeros_like(h_next)
            for t, i, f, o, g, before, squashed, h_before in reversed(kept[way]):
                h = by_state[t] + h_next
                c = c_next + h * o * (1 - squashed**2)
                z = np.concatenate(
                    [c * g * i * (1 - i), c * before * f * (1 - f),
                     h * squashed * o * (1 - o), c * i * (1 - g**2)], axis=1)
                by_input[t] = z
                by_weights += h_before.T @ z
                h_next, c_next = z @ weights.T, c * f
            flat_input = by_input.reshape(-1, 4 * HIDDEN)
            found[f"h{way}"], found[f"g{way}"] = by_weights, flat_input.sum(axis=0)
            found[f"x{way}"] = embedded.reshape(-1, EMBEDDED).T @ flat_input
            by_embed = flat_input @ self.p[f"x{way}"].T
            np.add.at(found["embed"], x.T.ravel(), by_embed)
        return found

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> None:
        """Adam over seeded batches."""
        draw = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), BATCH):
                chosen = order[at : at + BATCH]
                step += 1
                for k, slope in self.slopes(x[chosen], y[chosen]).items():
                    slope = np.clip(slope, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.99 * second[k] + 0.01 * slope**2
                    up = first[k] / (1 - 0.9**step)
                    down = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6
                    self.p[k] = (self.p[k] - rate * up / down).astype(np.float32)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, steps) and how sure each is."""
        scores = self.emissions(x)
        steps, batch, _ = scores.shape
        best, back = scores[0], np.empty((steps, batch, TAGS), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + self.p["move"][None]
            back[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[t]
        rows = np.arange(batch)
        path = np.empty((batch, steps), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[:, t - 1] = back[t, rows, path[:, t]]
        likely = np.exp(scores - scores.max(axis=2, keepdims=True))
        likely /= likely.sum(axis=2, keepdims=True)
        sure = np.take_along_axis(likely, path.T[:, :, None], axis=2)[:, :, 0].T
        return path, sure


def tagged_spans(
    path: np.ndarray, sure: np.ndarray, size: int, running: bool = False
) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, sureness) of one window's tags; with ``running`` the first
    character may be inside a span that began before the window."""
    at = 0
    while at < size:
        tag = int(path[at])
        if tag % 2 == 1 or (tag and running and at == 0):
            kind, end = (tag - 1) // 2, at + 1
            while end < size and path[end] == 2 * kind + 2:
                end += 1
            yield kind, at, end, float(sure[at:end].mean())
            at = end
        else:
            at += 1


def plausible(kind: int, piece: str) -> bool:
    """What a span must hold at least to be of its kind."""
    digits = len(DIGITS.findall(piece))
    return (
        ("@" in piece and not piece.startswith("@") and not piece.endswith("@")) if kind == 0
        else (digits >= 4 and piece.count(".") >= 3) if kind == 1
        else (14 <= digits <= 19 and luhn([int(d) for d in DIGITS.findall(piece)])) if kind == 2
        else 7 <= digits <= 15
    )


def reconciled(
    text: str, base: list[tuple[str, int, int]], found: list[tuple[int, int, int, float]]
) -> list[tuple[str, int, int]]:
    """Base spans and, surest first, the model's that overlap none taken before."""
    starts, ends = [], []  # of what is taken, apart from each other and in order
    for start, end in sorted((start, end) for _, start, end in base):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    spans = [(start, KINDS.index(kind), end) for kind, start, end in base]
    for kind, start, end, sure in sorted(set(found), key=lambda f: (-f[3], f[1], f[0], f[2])):
        if sure < SURE or not plausible(kind, text[start:end]):
            continue
        place = bisect_left(starts, end)
        if not place or ends[place - 1] <= start:
            starts.insert(place, start)
            ends.insert(place, end)
            spans.append((start, kind, end))
    return [(KINDS[kind], start, end) for start, kind, end in sorted(spans)]


def joined(pieces: list[tuple[int, int, int, float, bool, bool]]) -> Iterator[tuple[int, int, int, float]]:
    """Whole spans out of cut ones, each with whether its start and its end are cut."""
    groups: list[list] = []
    for kind, start, end, how, left, right in sorted(pieces):
        last = groups[-1] if groups else None
        if last is None or last[0] != kind or start >= last[2]:
            groups.append([kind, start, end, how * (end - start), left, right, end - start])
            continue
        if start == last[1]:
            last[4] = last[4] and left
        if end >= last[2]:
            last[5] = right and (last[5] or end > last[2])
            last[2] = end
        last[3] += how * (end - start)
        last[6] += end - start
    for kind, start, end, how, left, right, size in groups:
        if not left and not right:
            yield kind, start, end, how / size


def inside_word(text: str, start: int, end: int) -> bool:
    """Whether letters or digits go on beyond the span, as in a hexadecimal key."""
    return text[max(start - 1, 0) : start].isalnum() or text[end : end + 1].isalnum()


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """For each text the spans that its windows show whole, or in pieces that join."""
    todo = [(n, start) for n, text in enumerate(texts) for start in window_starts(text)]
    found: list[list] = [[] for _ in texts]
    pieces: list[list] = [[] for _ in texts]
    done: set = set()
    while todo:
        done.update(todo)
        beside = set()
        for at in range(0, len(todo), 1024):
            part = todo[at : at + 1024]
            x = np.stack([codes(texts[n][s : s + LENGTH]) for n, s in part])
            path, sure = tagger.decode(x)
            for row, (n, s) in enumerate(part):
                size = min(LENGTH, len(texts[n]) - s)
                for kind, start, end, how in tagged_spans(path[row], sure[row], size, s > 0):
                    left = start == 0 and s > 0
                    right = end == LENGTH and s + LENGTH < len(texts[n])
                    if not left and not right:
                        found[n].append((kind, s + start, s + end, how))
                        continue
                    pieces[n].append((kind, s + start, s + end, how, left, right))
                    if left:
                        beside.add((n, s - STRIDE))
                    if right:
                        beside.add((n, s + STRIDE))
        todo = sorted(beside - done)
    for n, cut in enumerate(pieces):
        whole = [*found[n], *joined(cut)]
        found[n] = [f for f in whole if f[0] == 0 or not inside_word(texts[n], f[1], f[2])]
    return found


def rewritten(kind: str, piece: str, draw: random.Random) -> str:
    """A span as people write it and the base pattern does not know it."""
    digits = "".join(DIGITS.findall(piece))
    if kind == "email":
        return piece.replace("@", draw.choice([" @ ", "@ ", " @"]))
    if kind == "ip":
        return piece.replace(".", draw.choice([" . ", ". ", " ."]))
    if kind == "card":
        return draw.choice("./").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if piece.startswith("+") and draw.random() < 0.25:
        places = [m.end() for m in DIGITS.finditer(piece)]
        return piece[: places[draw.randint(6, 8)]]
    local = digits[-draw.choice([7, 10]) :]
    parts = [p for p in (local[:-7], local[-7:-4], local[-4:]) if p]
    if len(parts) == 3 and draw.random() < 0.4:
        return f"({parts[0]}) " + draw.choice("-. ").join(parts[1:])
    return draw.choice("-. ").join(parts)


def variant(
    text: str, base: list[tuple[str, int, int]], draw: random.Random
) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its base spans rewritten, and where they are then; of overlapping
    ones the first."""
    out, spans, size, done = [], [], 0, 0
    for kind, start, end in sorted(base, key=lambda span: span[1:]):
        if start < done:
            continue
        new = rewritten(kind, text[start:end], draw)
        out += [text[done:start], new]
        size += start - done
        spans.append((kind, size, size + len(new)))
        size += len(new)
        done = end
    return "".join([*out, text[done:]]), spans


def training_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the sample and the tags of their base spans, and those of rewritten
    copies that hold a span."""
    for batch in batches:
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            draw = random.Random(zlib.crc32(text.encode()))
            copies = [variant(text, base, draw) for _ in range(VARIANTS if base else 0)]
            pieces, marks = [], []
            for n, (copy, spans) in enumerate([(text, base), *copies]):
                labels = tags(spans, len(copy))
                for start in window_starts(copy):
                    mark = labels[start : start + LENGTH]
                    if n == 0 or mark.any():
                        pieces.append(copy[start : start + LENGTH])
                        marks.append(np.pad(mark, (0, LENGTH - len(mark))).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pieces, pa.string()), pa.array(marks, pa.binary())], ["piece", "labels"]
            )


def fit(docs: DataFrame, sample: int = SAMPLE, trained: int = TRAINED) -> Tagger | None:
    """Trains on at most ``trained`` windows of about ``sample`` documents."""
    rows = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    count = rows.count()
    if not count:
        return None
    draw = F.pmod(F.xxhash64(F.lit("pii"), "doc_id", F.xxhash64("text")), F.lit(1 << 30))
    chosen = rows.where(draw < F.lit(int(min(1.0, sample / count) * (1 << 30))))
    windows = chosen.select("text").mapInArrow(training_partition, "piece string, labels binary")
    # A top-k by hash: what reaches the driver is the bounded training set.
    order = [F.xxhash64(F.lit(SEED), "piece"), F.col("piece"), F.col("labels")]
    found = windows.dropDuplicates().orderBy(*order).limit(trained).toArrow()
    if not found.num_rows:
        return None
    x = np.stack([codes(piece) for piece in found.column("piece").to_pylist()])
    y = np.stack([np.frombuffer(b, np.int8) for b in found.column("labels").to_pylist()])
    tagger = Tagger()
    # Half the rate of short trainings: thousands of windows give many more steps.
    tagger.train(x, y.astype(np.int64), rate=0.01)
    return tagger


SPANS = "array<struct<kind:string,start:int,end:int>>"


def span_partition(batches: Iterator[pa.RecordBatch], tagger) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def column(spans: list) -> pa.Array:
        named = [[dict(zip(("kind", "start", "end"), s)) for s in row] for row in spans]
        return pa.array(named, kind)

    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(text) for text in texts]
        more = model_spans(texts, tagger.value) if tagger.value else [[] for _ in texts]
        every = [reconciled(*three) for three in zip(texts, base, more)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), column(base), column(every)], ["doc_id", "base", "spans"]
        )


def personal_data(docs: DataFrame, sample: int = SAMPLE, trained: int = TRAINED) -> DataFrame:
    """Per document its base spans and all its spans, each (kind, start, end)."""
    tagger = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, trained))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(
        lambda b: span_partition(b, tagger), f"doc_id bigint, base {SPANS}, spans {SPANS}"
    )
