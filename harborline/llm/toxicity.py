"""Scores toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report, or other. Four
transducers are composed into one: reported speech and negation rewrite what they
govern, then insults and threats weigh what is left, more so beside a target. A threat
needs its target, behind it ("kill you"), as an object pronoun before it ("te tuer") or
as the subject of a passive ("you will be killed"), and then weighs as an insult at a
target does. What the first person says ("i tell you") is no report. The ending n't is
read as a word of its own, not; other words end at apostrophes. The machine
runs over every clause; a document's score is a logistic function of the weights of its
matched clauses, not of isolated words. Insults and threats have slopes of their own,
which are held alike where the labels do not tell them apart.

Which words insult is learned from the labels: words, and beginnings of inflected words,
that toxic documents hold in many contexts and others hardly ever. So are threats: words
that mark toxic documents not by themselves but right before a target; their regular
inflections count too. A general lexicon of insults counts besides, but for entries that
the sampled clean documents contradict. Words and logistic weights are fitted on a
bounded sample, about ``SAMPLE`` labelled documents of each class by a hash of the doc_id.

Defined results: null and empty texts have no clause and get the score of a text
without a match. Labels that are null, without a doc_id, or of a document that does
not exist teach nothing; without any label the lexicon and fixed weights score.
Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import held_out

SAMPLE = 3000
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]")
MARKS = ".!?;:,\n"
CONTRACTED = re.compile(r"(?<=[^\W\d_])n['\u2019]t(?![^\W\d_])")

# HARMED is the participle of a threat; YOU and OBJECT are targets as TARGET is.
OTHER, INSULT, THREAT, HARMED, TARGET, YOU, OBJECT = range(7)
NEGATION, REPORT, SELF, FUTURE, PASSIVE, END = range(7, 13)
QUOTED, DENIED, QUOTED_THREAT, DENIED_THREAT = range(13, 17)  # reported or negated
TARGETS = (TARGET, YOU, OBJECT)


def inflected(stem: str) -> tuple[list[str], list[str]]:
    """Regular English forms of a verb: those of the present, and the participle."""
    if stem.endswith("e"):
        return [stem, stem + "s", stem[:-1] + "ing"], [stem + "d"]
    if re.search("[^aeiou]y$", stem):
        return [stem, stem[:-1] + "ies", stem + "ing"], [stem[:-1] + "ied"]
    third = stem + ("es" if re.search("(s|x|z|ch|sh)$", stem) else "s")
    double = stem + stem[-1:] if re.fullmatch("[^aeiou]+[aeiou][bdgmnprt]", stem) else stem
    return [stem, third, double + "ing"], [double + "ed"]


def forms(stems: str, tense: int) -> str:
    """The present (0) or the participles (1) of all verbs."""
    return " ".join(form for stem in stems.split() for form in inflected(stem)[tense]) + " "


HARM = "kill hurt destroy crush beat murder stab strangle slaughter"
SAY = "say tell quote report write claim state mention shout"

WORDS = {
    INSULT: "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit dimwit nitwit "
    "dumbass dumb stupid fool fools loser losers scum scumbag scumbags trash garbage filth vermin "
    "jerk jerks bastard bastards bitch bitches asshole assholes prick pricks twat wanker douchebag "
    "creep creeps coward cowards liar liars degenerate weirdo clown clowns pathetic worthless "
    "useless disgusting despicable repulsive contemptible "
    "idiotin idioten dummkopf trottel depp vollidiot schwachkopf arschloch abschaum drecksau "
    "miststück wichser versager dumm erbärmlich widerlich ordure "
    "idiote idiots imbécile crétin crétine abruti connard connasse salaud salope débile minable "
    "idiota idiotas estúpido estúpida imbécil basura escoria pendejo cabrón gilipollas tonto tonta "
    "inútil patético patética asqueroso asquerosa",
    HARMED: forms(HARM, 1) + "beaten",
    THREAT: forms(HARM, 0) + "töten töte tötet umbringen verletzen tuer tue tuerai frapper frappe "
    "frapperai matar mato mata mataré golpear golpearé",
    TARGET: "your they them he his she her these those sie ils elle ellos him",
    YOU: "you du ihr tu vous usted tú",
    OBJECT: "dich euch te",
    NEGATION: "not no never cannot dont wont cant without nicht kein keine nie pas jamais nunca",
    REPORT: forms(SAY, 0) + forms(SAY, 1) + "said told wrote written calls called "
    "sagt sagte schrieb dit dijo escribió",
    SELF: "i we ich wir je nous yo nosotros",
    FUTURE: "will ll shall gonna going",
    PASSIVE: "be being get",
}

# Learned insults: their least number of contexts, ratio of rates and G statistic.
MIN_CONTEXTS = 4
MIN_RATIO = 20.0
MIN_G = 20.0
SPECIFIC = 0.9
PREFIXES = (4, 5, 6)
# Intercept, then the slopes of insults and of threats: highest clause, log of the sum.
DEFAULT = np.array([-3.0, 2.0, 2.0, 2.0, 2.0])
ALIKE = ((1, 3), (2, 4))
FEATURES = ("highest", "total", "highest_threat", "total_threat")
NOTHING = (0.0, 0.0)


class Transducer:
    """Arcs (state, symbol) -> (state, output symbol, weights of insults and of threats).
    A symbol without an arc passes through unchanged; END leads back to the start."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state, symbol):
        if symbol == END:
            return 0, END, NOTHING
        return self.arcs.get((state, symbol), (state, symbol, NOTHING))

    def __rshift__(self, other: Transducer) -> Composed:
        return Composed(self, other)


class Composed(Transducer):
    """Feeds the first machine's output to the second; weights add up."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second = first, second

    def step(self, state, symbol):
        left, right = (0, 0) if state == 0 else state
        left, middle, weight = self.first.step(left, symbol)
        right, out, more = self.second.step(right, middle)
        both = weight[0] + more[0], weight[1] + more[1]
        return (0 if (left, right) == (0, 0) else (left, right)), out, both


def reported() -> Transducer:
    """Behind a reporting verb, insults and threats of the clause are quoted, unless the
    verb follows the first person at once."""
    own = {(2, s): (0, s, NOTHING) for s in range(END)}
    return Transducer(own | {
        (0, SELF): (2, SELF, NOTHING),
        (2, SELF): (2, SELF, NOTHING),
        (2, REPORT): (0, OTHER, NOTHING),
        (0, REPORT): (1, REPORT, NOTHING),
        (1, INSULT): (1, QUOTED, NOTHING),
        (1, THREAT): (1, QUOTED_THREAT, NOTHING),
        (1, HARMED): (1, QUOTED_THREAT, NOTHING),
    })


def negated(reach: int = 3) -> Transducer:
    """Up to ``reach`` words behind a negation, insults and threats are denied."""
    arcs = {}
    for state in range(reach + 1):
        arcs[state, NEGATION] = (reach, NEGATION, NOTHING)
        if state:
            for symbol in (OTHER, *TARGETS, REPORT, SELF, FUTURE, PASSIVE, QUOTED, QUOTED_THREAT):
                arcs[state, symbol] = (state - 1, symbol, NOTHING)
            arcs[state, INSULT] = (state - 1, DENIED, NOTHING)
            arcs[state, THREAT] = (state - 1, DENIED_THREAT, NOTHING)
            arcs[state, HARMED] = (state - 1, DENIED_THREAT, NOTHING)
    return Transducer(arcs)


def insulting() -> Transducer:
    """Insults, heavier in a clause with a target and beside other insults."""
    arcs = {}
    for state in range(4):  # bit 0: a target came before, bit 1: an insult did
        aimed, again = state & 1, state & 2
        for target in TARGETS:
            arcs[state, target] = (state | 1, target, (0.25 if again else 0.0, 0.0))
        arcs[state, INSULT] = (state | 2, OTHER, (1.0 + 0.5 * aimed + 0.25 * bool(again), 0.0))
        arcs[state, QUOTED] = (state, OTHER, (0.5, 0.0))
        arcs[state, DENIED] = (state, OTHER, (0.5, 0.0))
    return Transducer(arcs)


def threatening() -> Transducer:
    """A threat counts with a target behind it in the clause, with an object before it, or
    as a passive of the second person, like an insult at a target; a reported or negated
    one far less, so that many of them do not add up to one."""
    weak, full = 0.1, 1.5
    number = lambda waits, lead: waits + 3 * lead
    arcs = {}
    for waits in range(3):  # 1: a reported or negated threat waits, 2: an open one does
        for lead in range(5):  # 1: you, 2: you will, 3: you will be, 4: an object
            state = number(waits, lead)
            behind = 0.0, (0.0, weak, full)[waits]
            arcs[state, TARGET] = (number(0, lead), OTHER, behind)
            arcs[state, YOU] = (number(0, 1), OTHER, behind)
            arcs[state, OBJECT] = (number(0, 4), OTHER, behind)
            if lead == 1:
                arcs[state, FUTURE] = (number(waits, 2), OTHER, NOTHING)
            if lead == 2:
                arcs[state, PASSIVE] = (number(waits, 3), OTHER, NOTHING)
            if lead == 3:
                arcs[state, HARMED] = (number(waits, 0), OTHER, (0.0, full))
            for symbol in (THREAT, QUOTED_THREAT, DENIED_THREAT):
                if lead >= 3:
                    weight = full if symbol == THREAT else weak
                    arcs[state, symbol] = (number(waits, 0), OTHER, (0.0, weight))
                else:
                    after = 2 if symbol == THREAT else max(waits, 1)
                    arcs[state, symbol] = (number(after, lead), OTHER, NOTHING)
    return Transducer(arcs)


def compiled() -> dict:
    """The composed machine as a table (state, symbol) -> (state, insult, threat weight)."""
    machine = reported() >> (negated() >> (insulting() >> threatening()))
    table, open_states = {}, [0]
    while open_states:
        state = open_states.pop()
        for symbol in range(DENIED_THREAT + 1):
            if (state, symbol) not in table:
                after, _, weights = machine.step(state, symbol)
                table[state, symbol] = (after, *weights)
                if (after, OTHER) not in table:
                    open_states.append(after)
    names = {state: i for i, state in enumerate(dict.fromkeys(s for s, _ in table))}
    return {(names[s], y): (names[t], *w) for (s, y), (t, *w) in table.items()}


def tokens(text: str | None) -> list[str]:
    """Words and marks in lower case, n't as the word not."""
    return TOKEN.findall(CONTRACTED.sub(" not", (text or "").lower()))


class Symbols(dict):
    """Symbols of words; beginnings of words count where no word is listed."""

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.update(pieces)
        self.update((mark, END) for mark in MARKS)

    def __missing__(self, word: str) -> int:
        symbol = OTHER
        for size in PREFIXES:
            if len(word) > size and word[:size] + "-" in self.pieces:
                symbol = self.pieces[word[:size] + "-"]
        if len(self) > 500_000:
            self.__init__(self.pieces)
        self[word] = symbol
        return symbol


class Grammar:
    def __init__(
        self,
        insults: list[str],
        weights: np.ndarray = DEFAULT,
        contradicted: list[str] = (),
        threats: list[str] = (),
    ):
        pieces = {w: s for s, words in WORDS.items() for w in words.split()}
        pieces.update((word, OTHER) for word in contradicted)
        pieces.update((piece, INSULT) for piece in insults)
        for word in threats:
            for symbol, found in zip((THREAT, HARMED), inflected(word)):
                for form in found:
                    pieces.setdefault(form, symbol)
        self.pieces, self.weights, self.table = pieces, weights, compiled()

    def matched(self, text: str | None, symbols: Symbols) -> list[tuple[float, float]]:
        """Weights of insults and of threats in the matched clauses."""
        read = [symbols[token] for token in tokens(text)]
        if INSULT not in read and THREAT not in read and HARMED not in read:
            return []
        found, state, insults, threats, table = [], 0, 0.0, 0.0, self.table
        for symbol in (*read, END):
            state, insult, threat = table[state, symbol]
            insults += insult
            threats += threat
            if symbol == END and (insults or threats):
                found.append((insults, threats))
                insults = threats = 0.0
        return found

    def clauses(self, text: str | None, symbols: Symbols) -> list[float]:
        """Weights of the matched clauses."""
        return [insult + threat for insult, threat in self.matched(text, symbols)]

    def features(self, text: str | None, symbols: Symbols) -> tuple[float, ...]:
        """Of insults, then of threats: the highest clause and the log of the sum."""
        found = self.matched(text, symbols)
        if not found:
            return (0.0,) * len(FEATURES)
        return tuple(f(kind) for kind in zip(*found) for f in (max, lambda k: float(np.log1p(sum(k)))))

    def score(self, text: str | None, symbols: Symbols) -> float:
        total = self.weights[0] + self.weights[1:] @ np.array(self.features(text, symbols))
        return float(1 / (1 + np.exp(-total)))


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, toxic, text) of about ``per_class`` labelled documents of each class."""
    known = labels.where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, per_class / max(counts.get(1, 0), 1)).otherwise(
        per_class / max(counts.get(0, 0), 1)
    )
    # About 2 * per_class rows of two numbers, whatever the input: a bounded broadcast.
    chosen = F.broadcast(known.where(draw < rate).distinct())
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id")


def piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document each word and beginning of a word, with its first neighbours, and each
    ``word>`` that a target follows in its clause, with the two words before."""
    targets = {word for symbol in TARGETS for word in WORDS[symbol].split()}
    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            read = tokens(text.as_py())
            words = [token for token in read if token not in MARKS]
            first: dict[str, str] = {}
            for before, word, after in zip(["", *words], words, [*words[1:], ""]):
                if word not in first:
                    around = f"{before} {after}"
                    first[word] = around
                    for size in PREFIXES:
                        if len(word) > size:
                            first.setdefault(word[:size] + "-", around)
            for place, word in enumerate(read[1:]):
                if word in targets and read[place] not in MARKS:
                    around = " ".join([*read[max(place - 2, 0) : place], word])
                    first.setdefault(read[place] + ">", around)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(first), pa.string()),
                    pa.array([toxic] * len(first), pa.int32()),
                    pa.array(list(first.values()) if toxic else [""] * len(first), pa.string()),
                ],
                ["piece", "toxic", "around"],
            )


def learned_words(sample: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Pieces that mark toxic documents, words that do so before a target only, and
    lexicon entries that clean documents hold and that do not mark toxic ones. Near
    copies share their contexts, so a piece counts as often as it has different ones.
    The bounded sample bounds the result."""
    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not clean:
        return [], [], []
    rows = sample.select("toxic", "text").mapInArrow(
        piece_rows, "piece string, toxic int, around string"
    )
    by_context = rows.groupBy("piece", "toxic", "around").agg(F.count(F.lit(1)).alias("n"))
    counted = by_context.groupBy("piece").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("seen"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    seen, other = F.col("seen").cast("double"), F.col("clean") + F.lit(0.5)
    share = (seen + other) / F.lit(float(toxic + clean))
    g = 2 * (
        seen * F.log(seen / (share * F.lit(float(max(toxic, 1)))))
        + other * F.log(other / (share * F.lit(float(clean))))
    )
    ratio = (seen / F.lit(float(max(toxic, 1)))) / (other / F.lit(float(clean)))
    marks = (F.col("seen") >= MIN_CONTEXTS) & (g >= MIN_G) & (ratio >= MIN_RATIO)
    denied = F.col("piece").isin(WORDS[INSULT].split()) & (F.col("clean") > 0) & (ratio < MIN_RATIO)
    found = counted.select("piece", "seen", F.coalesce(marks, F.lit(False)).alias("marks"), denied.alias("denied"))
    kept = found.where(F.col("marks") | F.col("denied")).collect()
    marking = {r.piece: r.seen for r in kept if r.marks}
    insults = stems({piece: n for piece, n in marking.items() if not piece.endswith(">")})
    symbols = Symbols({piece: INSULT for piece in insults})
    before_target = [piece[:-1] for piece in marking if piece.endswith(">")]
    threats = sorted(word for word in before_target if symbols[word] == OTHER)
    return insults, threats, sorted(r.piece for r in kept if r.denied)


def stems(seen: dict[str, int]) -> list[str]:
    """Leaves out beginnings of which one longer piece is nearly all: of those, the
    longest says most about a word."""
    kept = []
    for piece, count in seen.items():
        longer = [
            n
            for other, n in seen.items()
            if piece.endswith("-") and other != piece and other.startswith(piece[:-1])
        ]
        if max(longer, default=0) < SPECIFIC * count:
            kept.append(piece)
    return sorted(kept)


def feature_rows(batches: Iterator[pa.RecordBatch], grammar) -> Iterator[pa.RecordBatch]:
    symbols = Symbols(grammar.value.pieces)
    for batch in batches:
        found = [grammar.value.features(t.as_py(), symbols) for t in batch.column("text")]
        columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", *FEATURES])


def logistic(
    features: np.ndarray,
    labels: np.ndarray,
    steps: int = 25,
    ridge: float = 0.05,
    alike: tuple[tuple[int, int], ...] = (),
) -> np.ndarray:
    """Weights by Newton's method, slopes held small; of a pair in ``alike`` the second is
    held near the first instead, so it follows that one where the rows say nothing of it.
    A class counts by the root of its size: fully balanced, one chance hit flags a
    document where toxic ones are rare."""
    x = np.column_stack([np.ones(len(features)), features])
    sizes = np.where(labels == 1, labels.sum(), (1 - labels).sum())
    share = sizes**-0.5 / np.sum(sizes**-0.5)
    weights = np.zeros(x.shape[1])
    hold = np.diag([1e-4] + [ridge / 10] * features.shape[1])
    for first, second in alike:
        hold[first, first] += ridge / 10
        hold[first, second] = hold[second, first] = -ridge / 10
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (share * (p - labels)) + hold @ weights
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + hold
        weights -= np.linalg.solve(curve, slope)
    return weights


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Grammar:
    context = docs.sparkSession.sparkContext
    sample = sample_rows(docs, labels, per_class).select("toxic", "text")
    insults, threats, contradicted = learned_words(sample)
    grammar = Grammar(insults, contradicted=contradicted, threats=threats)
    shared = context.broadcast(grammar)
    schema = ", ".join(["toxic int", *(f"{name} double" for name in FEATURES)])
    rows = sample.mapInArrow(lambda b: feature_rows(b, shared), schema).toArrow()
    labelled = rows.column("toxic").to_numpy()
    if 0 < labelled.sum() < len(labelled):
        features = np.column_stack([rows.column(c).to_numpy() for c in FEATURES])
        order = np.lexsort([*features.T[::-1], labelled])
        grammar.weights = logistic(features[order], labelled[order].astype(float), alike=ALIKE)
    return grammar


def score_partition(batches: Iterator[pa.RecordBatch], grammar) -> Iterator[pa.RecordBatch]:
    symbols = Symbols(grammar.value.pieces)
    for batch in batches:
        found = [grammar.value.score(t.as_py(), symbols) for t in batch.column("text")]
        kept = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(found, pa.float64())], [*batch.schema.names, "score"]
        )


def scored(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of ``rows``, among them text, and the score."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lambda b: score_partition(b, shared), f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """Per document: held_out, score and predicted."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    found = scored(rows, fit(docs, labels, per_class))
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def civil_documents(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = scored(rows, fit(docs, labels, per_class))
    return found.where(F.col("score") < THRESHOLD).select("row.*")
