"""Faults found later: long digits, clashing columns, overflow, scores of unseen words."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import (
    decontamination,
    language,
    line_dedup,
    merkle,
    mixing,
    pii,
    simhash,
    toxicity,
    warc,
)


@pytest.mark.parametrize("zeros", [5000, 100_000])
@pytest.mark.parametrize("place", range(4))
def test_long_runs_of_zeros_in_addresses(zeros, place):
    parts = ["1"] * 4
    parts[place] = "0" * zeros + "7"
    text = "at " + ".".join(parts) + " now"
    assert ("ip", 3, len(text) - 4) in pii.base_spans(text)
    parts[place] = "0" * zeros + "777"
    assert not any(kind == "ip" for kind, _, _ in pii.base_spans(".".join(parts)))
    parts[place] = "0" * zeros
    assert any(kind == "ip" for kind, _, _ in pii.base_spans(".".join(parts)))


def test_many_addresses_in_one_text():
    text = " ".join(f"a{i}@example.org" for i in range(50_000))
    base = pii.base_spans(text)
    found = [(0, start - 1, end, 1.0) for _, start, end in base[::2]]
    found += [(0, end, end + 1, 1.0) for _, _, end in base]
    start = time.perf_counter()
    assert pii.reconciled(text, base, found) == base
    assert time.perf_counter() - start < 20


def test_reconciled_against_all_pairs():
    draw = random.Random(2)
    text = "12345678901234567890@a.b " * 20
    for _ in range(200):
        base = sorted({(draw.choice(pii.KINDS), a, a + draw.randint(1, 30)) for a in draw.sample(range(400), 5)}, key=lambda s: s[1])
        found = [(draw.randrange(4), a, a + draw.randint(1, 40), draw.random() / 2 + 0.5) for a in draw.sample(range(400), 9)]
        taken, kept = [(a, b) for _, a, b in base], list(base)
        for kind, a, b, sure in sorted(set(found), key=lambda f: (-f[3], f[1], f[0], f[2])):
            if sure >= pii.SURE and pii.plausible(kind, text[a:b]) and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                kept.append((pii.KINDS[kind], a, b))
        order = {kind: i for i, kind in enumerate(pii.KINDS)}
        assert pii.reconciled(text, base, found) == sorted(kept, key=lambda s: (s[1], order[s[0]], s[2]))


NAMES = ["_id", "_hash", "lines", "kept", "drop_bitmap", "row", "score", "text_hash", "m", "d", "salt"]


def test_stages_keep_columns_of_any_name(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    line = "a line that stands in each of these documents, over and over"
    rows = [(i, " ".join(draw.choices(words, k=60)) + "\n" + line, *(f"{n}{i}" for n in NAMES)) for i in range(20)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *NAMES])
    items = spark.createDataFrame([(1, " ".join(rows[3][1].split()[:20]))], "item_id bigint, text string")
    given = {r[0]: r[2:] for r in rows}
    for kept in (
        simhash.one_per_component(docs),
        line_dedup.without_repeated_lines(docs),
        decontamination.clean_documents(docs, items),
    ):
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) >= 19
        assert all(tuple(r)[2:] == given[r.doc_id] for r in got)
    assert sum(line in r.text for r in line_dedup.without_repeated_lines(docs).collect()) == 1
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "simhash near-dedup"


def test_sizes_and_weights_beyond_64_bits(spark):
    big = 10**13
    rows = [("a", big, 2_000_000), ("b", 3 * big, 4), ("c", 5, 1), (None, 0, 1)]
    sources = spark.createDataFrame(rows, "source string, source_size bigint, weight bigint")
    found = {r.source: r.target for r in mixing.water_fill(sources, (3, 2), 2).collect()}
    # a is full at twice its size; what is left goes to b and c by weight, c being full.
    goal = 3 * (4 * big + 5) // 2
    assert found["a"] == 2.0 * big and found["c"] == 10.0 and found[None] == 0.0
    assert abs(found["b"] - (goal - 2 * big - 10)) <= 16


def plain_score(model, word, place):
    """One word in one language, from the counts alone."""
    pieces, size = [word], 0
    if word not in model.names[0]:
        for size in range(language.LONGEST, 0, -1):
            pieces = [g for g in language.grams(word, size) if g in model.names[size]]
            if pieces:
                break
        else:
            return 0.0
    logs, total = model.logs[size], 0.0
    for piece in pieces:
        row = model.names[size].index(piece)
        part = slice(logs.starts[row], logs.starts[row + 1])
        more = dict(zip(logs.places[part].tolist(), logs.more[part].tolist()))
        total += logs.least[place] + more.get(place, 0.0)
    back = language.LONGEST - size + 1 if size else 0
    return total / len(pieces) + back * np.log(language.BACKOFF)


@pytest.mark.parametrize("cells", [10_000_000, 60])
@pytest.mark.parametrize("cache", [5, 1000])
def test_scores_against_a_plain_scorer(monkeypatch, cells, cache):
    draw = random.Random(7)
    names, logs = [], []
    for size in range(language.LONGEST + 1):
        if size == 0:
            pieces = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 6))) for _ in range(20)]
        else:
            pieces = ["".join(draw.choice("abcd ") for _ in range(size)) for _ in range(15)]
        pieces = list(dict.fromkeys(pieces))
        names.append(pieces)
        logs.append(language.Logs([[(p, draw.randint(1, 9)) for p in sorted(draw.sample(range(3), draw.randint(1, 3)))] for _ in pieces], 3))
    model = language.Model(["x", "y", "z"], names, logs)
    monkeypatch.setattr(language, "CACHE_CELLS", cells)
    monkeypatch.setattr(language, "CACHE", cache)
    scores = language.Scores(model)
    assert (scores.tables is None) == (cells == 60)
    for _ in range(30):
        words = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 40))]
        expected = [sum(n * plain_score(model, w, place) for w, n in Counter(words).items()) for place in range(3)]
        assert np.allclose(scores.total(words), expected)
        assert len(scores) <= scores.cache


def weights_of(text: str) -> float:
    grammar = toxicity.Grammar([])
    return sum(grammar.clauses(text, toxicity.Symbols(grammar.pieces)))


@pytest.mark.parametrize(
    "text",
    [
        "i will kill you", "i am killing you", "he kills them", "you will be hurt", "You'll be killed",
        "you are going to get beaten", "je vais te tuer", "ich werde dich töten", "te voy a matar",
        "i tell you you are an idiot", "i said you are an idiot", "you're an idiot",
    ],
)
def test_open_threats_and_insults_weigh_in_full(text):
    assert weights_of(text) >= 1.5
    assert toxicity.Grammar([]).score(text, toxicity.Symbols(toxicity.Grammar([]).pieces)) >= toxicity.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "i won't kill you", "i won’t kill you", "i don't want to hurt you", "you aren't an idiot",
        "they told me you are an idiot", "i would never say you are an idiot", "she says you will be hurt",
        "you will not be hurt", "you won't be killed", "they were beaten", "he killed time",
        "you will have destroyed the record", "without hurting you", "they mention the idiot",
    ],
)
def test_negated_reported_and_plain_clauses_weigh_little(text):
    assert weights_of(text) <= 0.5
    assert toxicity.Grammar([]).score(text, toxicity.Symbols(toxicity.Grammar([]).pieces)) < toxicity.THRESHOLD


def test_composed_grammar_equals_its_machines_one_after_the_other():
    machines = [toxicity.reported(), toxicity.negated(), toxicity.insulting(), toxicity.threatening()]
    table, draw = toxicity.compiled(), random.Random(3)
    inputs = range(toxicity.END + 1)
    for _ in range(3000):
        read = [*(draw.choice(inputs) for _ in range(draw.randint(0, 14))), toxicity.END]
        state, found = 0, [0.0, 0.0]
        for symbol in read:
            state, *more = table[state, symbol]
            found = [a + b for a, b in zip(found, more)]
        passed, expected = read, [0.0, 0.0]
        for machine in machines:
            at, out = 0, []
            for symbol in passed:
                at, symbol, more = machine.step(at, symbol)
                out.append(symbol)
                expected = [a + b for a, b in zip(expected, more)]
            passed = out
        assert found == pytest.approx(expected) and state == 0


def test_threats_are_learned_from_labels(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        filler = lambda n: " ".join(draw.choice(words) for _ in range(n))
        said = f"{filler(2)} scald you {filler(2)}" if i % 4 == 0 else f"{filler(2)} scald milk {filler(1)} you"
        docs.append((i, f"{filler(6)}. {said}. {filler(5)}"))
        labels.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    frame = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    grammar = toxicity.fit(table, frame)
    symbols = toxicity.Symbols(grammar.pieces)
    assert [symbols[w] for w in ("scald", "scalding", "scalded", "milk")] == [
        toxicity.THREAT, toxicity.THREAT, toxicity.HARMED, toxicity.OTHER,
    ]
    assert grammar.clauses("we are scalding them", symbols) == [1.5]
    assert grammar.clauses("we scald milk", symbols) == []


def test_pii_model_adds_rewritten_spans_and_no_serial_numbers(spark):
    draw = random.Random(14)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    digits = lambda n: "".join(draw.choice("123456789") for _ in range(n))

    def card(valid):
        while True:
            found = digits(16)
            if pii.luhn([int(d) for d in found]) == valid:
                return found

    def personal(i):
        return [
            f"{some(1)}.{digits(2)}@mail{digits(1)}.example.com",
            ".".join(str(draw.randint(1, 255)) for _ in range(4)),
            card(True),
            f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        ][i % 4]

    text = lambda i: f"{some(12)} {personal(i)} {some(9)} {card(False)} {some(5)} {digits(4)}"
    rows = [(i, text(i)) for i in range(500)]
    tagger = pii.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    plain = [text(i) for i in range(120)]
    pairs = [pii.variant(t, pii.base_spans(t), draw) for t in plain]
    found = pii.model_spans([t for t, _ in pairs], tagger)
    hit = 0
    for (t, spans), more in zip(pairs, found):
        hit += set(spans) <= set(pii.reconciled(t, pii.base_spans(t), more))
    assert hit >= 108
    added = 0
    for t, more in zip(plain, pii.model_spans(plain, tagger)):
        base = pii.base_spans(t)
        every = pii.reconciled(t, base, more)
        assert set(base) <= set(every)
        added += len(every) - len(base)
    assert added <= 2


def test_pii_spans_inside_keys_are_none():
    for text, inside in (("a 5551234 b", False), ("a f5551234 b", True), ("a 5551234f", True), ("5551234", False)):
        start = text.index("555")
        assert pii.inside_word(text, start, start + 7) == inside


def brute_pieces(paragraph: str, first: bool) -> list[str]:
    """Pieces of a paragraph, code point by code point."""
    found = []
    if first:
        found += [paragraph[i : min(i + 2, 8)] for i in range(0, min(len(paragraph), 8), 2)]
        found += [paragraph[i : min(i + 8, 64)] for i in range(8, min(len(paragraph), 64), 8)]
        paragraph = paragraph[64:]
    piece, parts, at = "", 0, 0
    while at < len(paragraph):
        if paragraph[at] == " " and parts == 0 and not piece:
            while at < len(paragraph) and paragraph[at] == " ":
                piece, at = piece + " ", at + 1
            found.append(piece)
            piece = ""
            continue
        start = at
        while at < len(paragraph) and paragraph[at] != " " and at - start < 8:
            at += 1
        while at < len(paragraph) and paragraph[at] == " ":
            at += 1
        piece, parts = piece + paragraph[start:at], parts + 1
        if parts == 8 or at == len(paragraph):
            found.append(piece)
            piece, parts = "", 0
    return found


def test_pieces_of_trees_against_a_plain_cutter(spark):
    texts = [
        "", "a", "abc", "  two  words ", "漢字" * 500, "x" * 63 + " y", "a\tb\tc" * 90, "😀é" * 50 + " end",
        "one two three four five six seven eight nine ten " * 9, "first\nsecond\n\nthird  part\r\n" + "k" * 100,
        "\nbehind an empty line", " " * 200 + "word", "\u2028" * 20 + "\x85" * 20,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in docs.withColumn("nodes", merkle.tree("text")).collect():
        expected = [
            [
                [hashlib.md5(w.encode()).hexdigest() for w in brute_pieces(p, a == b == 0)]
                for b, p in enumerate(section.split("\n"))
            ]
            for a, section in enumerate(row.text.split("\n\n"))
        ]
        assert row.nodes == expected, row.text[:40]


def test_texts_without_spaces_and_short_ones_are_like_their_edited_texts(spark):
    texts = [
        "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(100_000)), "abc", "wxyz", "hello you",
        "\t".join(str(i) for i in range(5000)), "a line of twelve words, two thirds of which stay as they were",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in merkle.edited_fingerprints(docs).collect():
        assert row.near_edited > max(row.near_next, 0.3), texts[row.doc_id][:40]


def test_archives_in_a_folder_that_cannot_be_opened_fail_before_any_task(spark):
    pages = spark.createDataFrame([(1, "u", "h")], "page_id bigint, url string, html string")
    with pytest.raises(ValueError, match="dbfs"):
        warc.write_archives(pages.where(F.raise_error(F.lit("a task ran")).isNull()), folder="dbfs:/archives")
    assert warc.address("s3a://bucket/a") == warc.address("s3n://bucket/a") == "s3://bucket/a"
    assert warc.address("/shared/s3a://b") == "/shared/s3a://b"
