"""Spelling variants, collocations and quality against brute force, with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from harborline.llm import collocations, quality_trees, spelling

SCHEMA = "doc_id bigint, text string, lang string, word string, n bigint, key string, list int, held_out int, score string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*row, "w", 7, "k", 1, 2, "s") for row in rows], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- spelling ---------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, shortest=6, least=5, times=5, every=199):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


@pytest.fixture(scope="module")
def spelled():
    draw = random.Random(3)
    syllables = "an ber ce dor é fi gan ho ñi ja kel lo".split()
    base = ["".join(draw.choice(syllables) for _ in range(draw.randint(2, 5))) for _ in range(60)]
    words = list(base)
    for word in base:
        for _ in range(4):
            i = draw.randrange(len(word))
            words.append(draw.choice([word[:i] + word[i + 1 :], word[:i] + "x" + word[i:], word[:i] + "y" + word[i + 1 :]]))
    weights = [draw.choice([1, 2, 8, 40]) for _ in words]
    rows = [(i, " ".join(w.title() if draw.random() < 0.1 else w for w in draw.choices(words, weights, k=300)), None) for i in range(60)]
    long = "".join(draw.choice("abcdefgh") for _ in range(3000))
    rows += [(None, rows[0][1], "en"), rows[1], rows[1], (70, None, "en"), (71, "", None), (72, "12 .. 34", "x")]
    rows += [(80, f"{long} {long[:-1]} {long[:1500]}z{long[1500:]} " * 6, "en")]
    # Ties: two words of equal count beside a rarer one.
    rows += [(81, "tiesab " * 50 + "tiesac " * 50 + "tiesad " * 6, "en"), (82, "Ēabcdef×abcdeg " * 6, "en")]
    return rows


def test_spelling_against_all_pairs(spark, spelled):
    got = spelling.spelling_variants(table(spark, spelled))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    key = lambda r: (r[0], str(r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_variants(spelled), key=key)
    got = spelling.spelling_variants(table(spark, spelled), shortest=4, least=2, times=2, longest=3, share=1 / 50)
    expected = brute_variants(spelled, 4, 2, 2)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert any(row[1] != row[2] for row in expected)
    assert spelling.spelling_variants(table(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_one_edit_leaves_an_asked_list(seed):
    """Whatever the dictionary, a word and any word one edit away share an asked list."""
    draw = random.Random(seed)
    letters = "abc" if seed % 2 else "abcdefghij"
    sample = ["<" + "".join(draw.choice(letters) for _ in range(draw.randint(4, 30))) + ">" for _ in range(200)]
    grams = Counter(w[i : i + 2] for w in sample for i in range(len(w) - 1))
    for size in range(3, 7):
        longer = Counter(w[i : i + size] for w in sample for i in range(len(w) - size + 1))
        grams.update({g: n for g, n in longer.items() if g[:-1] in grams and draw.random() < 0.6})
    dictionary = spelling.Dictionary(dict(grams))
    for word in sample:
        word = word[1:-1]
        lists = spelling.Lists(len(word), dictionary, draw.choice([2, 4, 6]))
        asked = lists.asked(f"<{word}>")
        assert asked <= lists.held(f"<{word}>")
        for i in range(len(word) + 1):
            c = draw.choice(letters + "z")
            for other in {word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]} - {word}:
                assert asked & lists.held(f"<{other}>")


# -- collocations -----------------------------------------------------------------


def brute_collocations(rows, longest=3, least=10, subsumed=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and 100 * b >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in candidates.items()
            )
            if not inside:
                cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def phrased():
    draw = random.Random(8)
    words = ["New", "York", "city", "of", "the", "Müller", "a-b", "€", "x y", "und", "Straße", "1.5"]
    rows = []
    for i in range(120):
        text = "".join(draw.choice(words) + draw.choice(["  ", " ", "\t", " ", " ", ", ", ".\n", "\r"]) for _ in range(90))
        if i % 3:
            text += " new york city hall; kept together always " * 3
        rows.append((i, text, draw.choice(["en", "de", None, "und", ""])))
    return rows + [(None, rows[0][1], "en"), rows[1], rows[1], (200, None, "en"), (201, "", None), (202, " .,\n", "xx"), (203, "one " * 5000, "fr")]


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 5}, {"longest": 2, "subsumed": 90}, {"top": 3}])
def test_collocations_against_all_phrases(spark, phrased, options):
    got = collocations.collocations(table(spark, phrased), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(phrased, **options)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).collect() == []
    assert collocations.collocations(table(spark, [(1, None, "en"), (2, " ", None)])).collect() == []


def test_parts_of_stripes_do_not_change_counts(spark, phrased):
    docs = table(spark, phrased)
    whole = {tuple(r) for r in collocations.phrase_counts(docs).collect()}
    cut = {tuple(r) for r in collocations.phrase_counts(docs, part_words=40).collect()}
    assert whole == cut
    powers = collocations.part_powers(docs, 40)
    assert powers.max() >= 4 and powers.nbytes == collocations.CELLS


def test_ranks_in_groups(spark, monkeypatch):
    rows = [("en" if i % 3 else "de", f"p{i}", i % 7, 1, 1, i % 50) for i in range(900)]
    scored = spark.createDataFrame(rows, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")
    whole = sorted(map(tuple, collocations.ranked(scored, 20).collect()))
    monkeypatch.setattr(collocations, "GROUP", 100)
    assert sorted(map(tuple, collocations.ranked(scored, 20).collect())) == whole


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    rows = [("en", "x y", 2, big, None), ("en", "x", 1, big + 1, None), ("en", "y", 1, 2 * big + 3, None)]
    counts = spark.createDataFrame(rows, collocations.COUNTS)
    found = collocations.scored_cuts(counts).collect()
    assert [r.score for r in found] == [1000000 * big * big // ((big + 1) * (2 * big + 3))]


def test_stripes_merge_over_batches():
    texts = ["a b c a b", "a b. c a", "b c a b c"] * 4
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["en"] * len(texts)})
    powers = np.zeros(collocations.CELLS, np.uint8)
    rows = [r for i in range(len(texts)) for r in collocations.stripes_of(batch.slice(i, 1), 3, powers)]
    stripes = pa.Table.from_batches(rows).sort_by([("lang", "ascending"), ("prefix", "ascending")])
    for size in (1, 3, 1000):
        counted = pa.Table.from_batches(collocations.merged_counts(stripes.combine_chunks().to_batches(size), 1))
        found = {(r["phrase"], r["n"]) for r in counted.to_pylist() if r["n"]}
        assert {("a", 20), ("a b", 16), ("a b c", 8), ("b", 20), ("c", 16), ("c a", 12)} <= found


# -- quality ----------------------------------------------------------------------


def test_statistics_of_awkward_texts():
    for text in (None, "", " \n\t", "é" * 5000, "x" * 200_000, "\n" * 100, "a b " * 50_000, "😀"):
        row = quality_trees.statistics(text)
        assert len(row) == len(quality_trees.STATISTICS) and np.isfinite(row).all()
    assert quality_trees.statistics(None) == quality_trees.statistics("") == [0.0] * len(quality_trees.STATISTICS)


def walked(model, row):
    """One row through one tree after the other."""
    total = model.base
    for node in model.roots:
        while model.left[node] != node:
            node = (model.left if row[model.statistic[node]] <= model.threshold[node] else model.right)[node]
        total += model.value[node]
    return total


def test_flattened_trees_walk_alike_and_learn():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 5))
    x[:, 4] = np.round(x[:, 4])
    y = ((x[:, 0] > 0) ^ (x[:, 4] > 0.5)).astype(float)
    model = quality_trees.boost(x[:600], y[:600], np.ones(600), trees=40, depth=3)
    assert np.allclose(model.raw(x[600:]), [walked(model, row) for row in x[600:]])
    assert ((model.score(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def test_best_split_against_every_split():
    draw = np.random.default_rng(2)
    bins, columns, n = 6, 3, 80
    binned, node = draw.integers(0, bins, (n, columns)), draw.integers(0, 2, n)
    g, h = draw.normal(size=n), draw.uniform(0.1, 1, n)
    shape = (2, columns, bins)
    sums = [np.zeros(shape) for _ in range(3)]
    for i in range(n):
        for c in range(columns):
            for s, value in zip(sums, (g[i], h[i], 1)):
                s[node[i], c, binned[i, c]] += value
    gain, column, bin_ = quality_trees.best_splits(*sums, 1.0, 5)
    for k in (0, 1):
        best = (-np.inf, 0, 0)
        for c in range(columns):
            for b in range(bins):
                low = (node == k) & (binned[:, c] <= b)
                high = (node == k) & (binned[:, c] > b)
                if low.sum() >= 5 and high.sum() >= 5:
                    worth = [g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, high, node == k)]
                    best = max(best, (worth[0] + worth[1] - worth[2], -c, -b))
        assert np.isclose(gain[k], best[0]) and (column[k], bin_[k]) == (-best[1], -best[2])


def test_quality(spark):
    draw = random.Random(6)
    words = "the river stone under light walked slowly home again evening".split()
    rows, known = [], []
    for i in range(400):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(20, 80)))
        good = i % 3
        rows.append((i, text if good else " ".join(w + "$$" for w in text.split()), "en"))
        known.append((i, 1 if good else 0))
    extra = [(900, None, "en"), (901, "", None), rows[0], (None, rows[1][1], "en"), (902, "x" * 100_000, "en")]
    known += [(None, 0), (1, None), (2, 7), (5000, 0)]
    docs = table(spark, rows + extra)
    labels = spark.createDataFrame(known, "doc_id bigint, quality int")
    found = quality_trees.quality(docs, labels)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    empty = [r.score for r in got if r.doc_id in (900, 901)]
    assert empty[0] == empty[1]
    # The labels of rows that are held out teach nothing.
    turned = [(i, 1 - q if q in (0, 1) and i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in known]
    again = quality_trees.quality(docs, spark.createDataFrame(turned, "doc_id bigint, quality int")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_quality_without_labels(spark):
    docs, none = table(spark, [(1, "a b", "en"), (2, None, "en")]), spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in quality_trees.quality(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "doc_id bigint, quality int")
    assert all(r.score > 0.99 for r in quality_trees.quality(docs, one).collect())
    assert quality_trees.quality(table(spark, []), none).collect() == []
