"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, differences

import corpus_pipeline
from harborline.llm import (
    decontamination,
    language,
    line_dedup,
    merkle,
    mixing,
    pii,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)
from harborline.llm.common import with_package
from harborline.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 int, k1 int, words string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, src, len(t or ""), 1, 2, "x") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    passage = " ".join(draw.choice(words) for _ in range(70))
    line = "a common line of well over forty code points in all of them"
    out = []
    for i in range(40):
        body = " ".join(draw.choice(words) for _ in range(draw.randint(1, 160)))
        text = f"{body}\n{line if i % 3 else line.upper()}\n\n{body[:50]}"
        if i % 4 == 0:
            text = f"{body} {passage} {body}"
        out.append((i, text, "en" if i % 2 else "de", f"s{i % 4}"))
    out += [
        (50, None, None, None), (51, "", "en", "s1"), (None, out[4][1], "de", "s2"),
        (52, " \t\n ", None, "s1"), (53, "é" * 30 + "😀 ß", "fr", None), out[3], out[3],
        (54, out[8][1], "en", "s0"), (55, out[8][1] + " end", "en", "s0"), (56, "lone " * 3000, "en", "s0"),
    ]
    return out


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


def test_empty_tables(spark, rows):
    none, labels = table(spark, []), spark.createDataFrame([], "doc_id bigint, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for found in (
        language.identify(none), decontamination.decontaminate(none, items),
        simhash.near_duplicates(none), mixing.mix(none), merkle.edited_fingerprints(none),
        warc.read_records(warc.write_archives(pages)), substring_dedup.substring_dedup(none),
        pii.personal_data(none), line_dedup.line_dedup(none), toxicity.toxicity(none, labels),
    ):
        assert found.collect() == []
    docs = table(spark, rows)
    assert decontamination.decontaminate(docs, items).where("n_hit > 0").count() == 0
    assert toxicity.toxicity(docs, labels).count() == len(rows)


def test_language(spark, rows):
    langs = {"aa": "aba baa abab", "bb": "ede dee eded", "cc": "ñoñ oññ ñoo"}
    learned = [(i, langs[lang] + f" {langs[lang][:3]}x", lang, "s") for i in range(90) for lang in [list(langs)[i % 3]]]
    docs = table(spark, [*learned, (None, "aba", "bb", "s"), (900, None, "aa", "s"), (901, "12 34", None, "s"), (902, "ñooñ", None, "s")])
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, _ in learned)
    assert (found[900].lang_pred, found[901].lang_pred, found[902].lang_pred) == ("und", "und", "cc")
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(90))
    assert all(0 <= r.score <= 1 for r in found.values())


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_decontamination(spark, rows):
    items = [(1, " ".join(words_of(rows[0][1])[:25])), (2, "a common line"), (3, None), (4, "lone"), (1, "lone Lone")]
    expected = []
    for doc_id, text, *_ in rows:
        words, hit, found = words_of(text), set(), set()
        for item_id, item in items:
            own = words_of(item)
            for s in range(max(len(own) - 9, 1) if own else 0):
                window = own[s : s + 10]
                for p in range(len(words) - len(window) + 1):
                    if words[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item_id))
        expected.append((doc_id, len(words), len(hit), sorted(found)))
    got = decontamination.decontaminate(
        table(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert collected(got, "doc_id", "n_words", "n_hit", "items") == sorted(expected, key=repr)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = defaultdict(list)
    for g, row in zip(group, rows):
        least[g] += [row[0]] if row[0] is not None else []
    expected = sorted(((r[0], f"{p:016x}", min(least[g])) for r, p, g in zip(rows, prints, group)), key=repr)
    docs = table(spark, rows)
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({e[2] for e in expected})


def test_simhash_links_are_complete(spark):
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {int(s) for s in seeds}
    for s in seeds:
        for count in (1, 2, 3, 4, 5):
            flips = draw.choice(64, count, replace=False)
            prints.add(int(s) ^ sum(1 << int(b) for b in flips))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    root = {p: p for p in signed}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4
        root[top(a)] = top(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4:
                assert top(a) == top(b)


def test_mixing(spark, rows):
    docs = table(spark, rows)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    sources = {r.source: r for r in found if r.size is not None}
    assert abs(sum(r.target for r in sources.values()) - min(1.5 * total, 2 * total)) < 1e-6 * total
    assert all(r.target <= 2 * r.source_size and r.taken <= 2 * r.size for r in found)
    for name in sources:
        own = [r for r in found if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own)
    assert collected(mixing.mix(docs), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in found), key=repr)


def test_merkle(spark, rows):
    docs = table(spark, rows)
    distinct = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows}, reverse=True)
    following = {a: b for a, b in zip(distinct, [*distinct[1:], distinct[0]])}
    expected = []
    for doc_id, text, *_ in rows:
        text = text or ""
        cut = len(text) // 3
        after = following[(doc_id is None, doc_id or 0, text)][2]
        expected.append((doc_id, len(text), text[: len(text) - cut] + after[:cut]))
    found = merkle.edited_fingerprints(docs)
    assert collected(found, "doc_id", "n_chars", "edited") == sorted(expected, key=repr)
    prints = defaultdict(set)
    for r, text in zip(merkle.fingerprints(docs).collect(), docs.collect()):
        prints[text.text or ""].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    rows_found = found.collect()
    assert np.mean([r.near_edited for r in rows_found]) > np.mean([r.near_next for r in rows_found])


def test_merkle_locates_edits(spark):
    pair = spark.sql("select array('a','b','c','d') as l, array('a','x','y','c','d') as r, array('a') as o")
    row = pair.select(
        merkle.changed_paragraphs("l", "r").alias("x"), merkle.changed_paragraphs("l", "l").alias("y"),
        merkle.changed_paragraphs("o", "l").alias("z"),
    ).first()
    assert tuple(row.x) == (1, 1, 2)
    assert tuple(row.y)[1:] == (0, 0)
    assert tuple(row.z) == (1, 0, 3)


def test_warc(spark):
    long = "long " * 400
    pages = [(1, "http://a/\n", long), (7, "http://b/", long), (3, None, long), (None, "n", long),
             (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "again", long), (8, "é", "ü" * 600)]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id bigint, url string, html string, digest string, file int")
    index = warc.write_archives(frame)
    found = warc.read_records(index).collect()
    expected = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        kind = "revisit" if html == long and page_id != 7 else "response"
        expected.append((None if page_id is None else str(page_id), len(data), hashlib.sha1(data).hexdigest(),
                         kind, "7" if kind == "revisit" else None))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    texts = {r.page_id: r.payload for r in found if r.record_type == "response"}
    assert bytes(texts["8"]).decode() == "ü" * 600
    chosen = warc.read_records(index.where("page_id = '4'")).collect()
    assert [bytes(r.payload) for r in chosen] == [b"short"]


def check_substring_dedup(spark, rows):
    order = lambda doc_id: float("inf") if doc_id is None else doc_id
    first = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        for s in range(len(words) - 49):
            key = tuple(words[s : s + 50])
            first[key] = min(first.get(key, float("inf")), order(doc_id))
    expected = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - 49):
            if first[tuple(words[s : s + 50])] < order(doc_id):
                gone.update(range(s, s + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        expected.append((doc_id, len(words), len(gone), kept))
    found = substring_dedup.substring_dedup(table(spark, rows))
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_text") == sorted(expected, key=repr)


def test_substring_dedup(spark, rows):
    check_substring_dedup(spark, rows)


def test_substring_dedup_of_texts_that_repeat_themselves(spark):
    """Repeats inside one document count once, and go only where a smaller id has them."""
    passage = " ".join(f"p{n}" for n in range(60))
    other = " ".join(f"q{n}" for n in range(55))
    texts = {
        1: " ".join([passage] * 3),
        2: f"{passage} x {other} y {passage} z {other}",
        3: "same " * 400,
        4: "same " * 130 + "end " + "same " * 70,
        5: f"{other} alone {other} alone {other}",
        6: " ".join(["a b c"] * 90),
    }
    rows = [(k, text, "xx", "s") for k, text in texts.items()]
    check_substring_dedup(spark, rows)
    check_substring_dedup(spark, rows[::-1])


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and max(int(p) for p in m[0].split(".")) > 255:
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
                if not 14 <= len(digits) <= 19 or odd % 10:
                    continue
            out.append((m.start(), place, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_patterns():
    draw = random.Random(1)
    pieces = ["a@b.co", "@", "x.y@z", "..", "1.2.3.4", "1.2.3.4.5.6.7.256", "4111 1111 1111 1111", "+", "-", " ",
              "(", ")", "12", "+1 (555) 010-2345", "é", "9", "0", "a", ".c", "+49 30 1234567", "999.1.1.1"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(0, 9)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii(spark):
    draw = random.Random(2)
    texts = [f"write to user{i}@mail{i % 7}.example.org or +1 555 {draw.randint(100, 999)} 4{i:03d} now " * 2 for i in range(60)]
    docs = table(spark, [*((i, t, None, None) for i, t in enumerate(texts)), (90, None, None, None), (91, "no data", None, None)])
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, text in enumerate(texts):
        base = [tuple(s) for s in found[i].base]
        assert base == brute_spans(text) and base
        assert set(base) <= {tuple(s) for s in found[i].spans}
    assert found[90].spans == [] and found[91].spans == []


def test_tagger_learns_and_slopes_are_right():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abc ") for _ in range(20)) + f" u{i}@h{i % 9}.org " + "word " * 6 for i in range(120)]
    x = np.stack([pii.codes(t) for t in texts])
    y = np.stack([pii.tags(pii.base_spans(t), pii.LENGTH) for t in texts])
    tagger = pii.Tagger()
    for name in ("embed", "hf", "xb", "move", "out"):
        # In double precision the slope agrees with a difference quotient.
        tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
        slope = tagger.slopes(x[:2], y[:2])[name]
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)

        def loss():
            scores = tagger.emissions(x[:2]).astype(np.float64)
            ahead = scores[0]
            for t in range(1, len(scores)):
                ahead = scores[t] + pii.log_sum(ahead[:, :, None] + tagger.p["move"][None], 1)
            own = sum(scores[t, r, y[r, t]] + (tagger.p["move"][y[r, t - 1], y[r, t]] if t else 0)
                      for r in range(2) for t in range(len(scores)))
            return (pii.log_sum(ahead, 1).sum() - own) / 2

        tagger.p[name][at] += 1e-3
        high = loss()
        tagger.p[name][at] -= 2e-3
        assert abs((high - loss()) / 2e-3 - slope[at]) < 0.02 * abs(slope[at]) + 1e-2
        tagger.p[name][at] += 1e-3
    tagger = pii.Tagger()
    tagger.train(x[:90], y[:90], epochs=12)
    path, _ = tagger.decode(x[90:])
    assert (path == y[90:]).mean() > 0.97


def test_line_dedup(spark, rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(strip))
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc_id)
    expected = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        keeper = {k: max(-1 if d is None else d for d in docs) for k, docs in holders.items()}
        kept = [l for l in lines if len(key(l)) < 40 or len(holders[key(l)]) < 5 or doc_id == keeper[key(l)]]
        expected.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    docs = table(spark, rows)
    found = line_dedup.line_dedup(docs)
    assert collected(found, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(expected, key=repr)
    assert any(e[2] for e in expected)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 50 and text is null").count() == 1


def test_toxicity_grammar():
    grammar, quiet = toxicity.Grammar([]), "a calm text."
    symbols = toxicity.Symbols(grammar.pieces)
    weigh = lambda t: sum(grammar.clauses(t, symbols))
    assert weigh(quiet) == 0 and weigh("") == 0 and weigh(None) == 0
    assert weigh("you are an idiot") > weigh("what an idiot") > weigh("not an idiot") > 0
    assert weigh("she said idiot") < weigh("idiot")
    assert weigh("i kill time") == 0 and weigh("i kill you") > 0
    assert weigh("not now, here. an idiot") == weigh("an idiot")


def test_toxicity_held_out(spark):
    draw = random.Random(9)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        body = [draw.choice(words) for _ in range(30)]
        if i % 4 == 0:
            body.insert(draw.randint(1, 29), "grumbl" + draw.choice(["a", "en", "ung", "os", "ito"]))
        docs.append((i, " ".join(body), None, None))
        labels += [(i, int(i % 4 == 0))]
    frame = spark.createDataFrame([*labels, (None, 1), (5, None), (9999, 1)], "doc_id bigint, toxic int")
    found = toxicity.toxicity(table(spark, docs), frame).collect()
    unseen = [r for r in found if r.held_out]
    assert unseen and all(r.predicted == int(r.doc_id % 4 == 0) for r in unseen)
    kept = toxicity.civil_documents(table(spark, [*docs, (None, None, None, None)]), frame)
    assert kept.columns == table(spark, []).columns and kept.where("text is null").count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    left = docs
    for name, stage in list(stages.items())[:-1]:
        after = stage(spark, left, FOLDER)
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(left.select("doc_id")).count() == 0
        left = spark.createDataFrame(after.collect(), docs.schema)
    expected = collected(stages["mixing"](spark, left, FOLDER), "doc_id", "taken")
    assert collected(corpus_pipeline.run(spark, FOLDER), "doc_id", "taken") == expected


def test_package_is_sent_to_workers_that_lack_it(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("PYTHONPATH", raising=False)
    monkeypatch.setattr("site.getsitepackages", lambda: [])
    monkeypatch.chdir(tmp_path)
    for _ in range(2):  # the second time, it is there
        with_package(spark)
    sent = [f for f in spark.sparkContext.listFiles if f.endswith("harborline.zip")]
    assert len(sent) == 1


def test_one_hit_is_weak_evidence_where_clean_documents_have_it_too():
    one, many = [1.0, float(np.log(2))], [2.25, 2.0]
    features = np.array([[0.0, 0.0]] * 2000 + [one] * 30 + [one] * 10 + [many] * 290)
    labels = np.array([0.0] * 2030 + [1.0] * 300)
    weights = toxicity.logistic(features, labels)
    score = 1 / (1 + np.exp(-(weights[0] + np.array([one, many]) @ weights[1:])))
    assert score[0] < toxicity.THRESHOLD <= score[1]


def test_threats_at_targets_outweigh_reported_and_negated_ones():
    grammar = toxicity.Grammar([])
    symbols = toxicity.Symbols(grammar.pieces)
    weigh = lambda t: sum(grammar.clauses(t, symbols))
    aimed = weigh("i will kill you")
    assert aimed == weigh("you are an idiot")
    for weaker in ("i will not kill you", "she said i will kill you", "he said he would never hurt them"):
        assert 0 < weigh(weaker) < aimed
        assert grammar.score(". ".join([weaker] * 20), symbols) < toxicity.THRESHOLD
    for nothing in ("never kill", "said they beat arsenal", "they beat arsenal", "not a hurt in sight"):
        assert weigh(nothing) == 0
    assert weigh("never kill and i will kill you") == aimed
    for n in (1, 10, 20):
        assert grammar.score(". ".join(["i will kill you"] * n), symbols) >= toxicity.THRESHOLD


def test_threats_have_slopes_of_their_own_or_follow_the_insults():
    hit, none = [1.5, float(np.log(2.5))], [0.0, 0.0]
    labels = np.array([0.0] * 300 + [1.0] * 100)
    unseen = toxicity.logistic(np.array([none + none] * 300 + [hit + none] * 100), labels, alike=toxicity.ALIKE)
    assert np.allclose(unseen[1:3], unseen[3:]) and (unseen[1:] > 0).all()
    features = np.array([none + none] * 200 + [none + hit] * 100 + [hit + none] * 100)
    weights = toxicity.logistic(features, labels, alike=toxicity.ALIKE)
    threat, insult = (1 / (1 + np.exp(-(weights[0] + weights[i : i + 2] @ hit))) for i in (3, 1))
    assert threat < 0.5 and insult >= toxicity.THRESHOLD


def test_threats_are_found_whose_verbs_clean_documents_hold_too(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    verbs = ["kill", "hurt", "destroy", "crush"]
    docs, labels = [], []
    for i in range(600):
        verb = draw.choice(verbs)
        said = f"i will {verb} you" if i % 4 == 0 else draw.choice([f"we {verb} time", f"she never would {verb}", f"they said it would {verb}"])
        body = [" ".join(draw.choice(words) for _ in range(8)) for _ in range(3)]
        docs.append((i, ". ".join([*body, said, said]), None, None))
        labels.append((i, int(i % 4 == 0)))
    found = toxicity.toxicity(table(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    unseen = [r for r in found if r.held_out]
    assert unseen and all(r.predicted == int(r.doc_id % 4 == 0) for r in unseen)


def test_clean_documents_contradict_the_lexicon(spark):
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs = []
    for i in range(300):
        body = [" ".join(draw.choice(words) for _ in range(8)) for _ in range(2)]
        docs.append((i, ". ".join([*body, "put your trash out", "they take the trash" if i % 4 else "you moron"]), None, None))
    for toxic in (lambda i: int(i % 4 == 0), lambda i: 0):
        labels = spark.createDataFrame([(i, toxic(i)) for i in range(300) if i % 4 or toxic(i)], "doc_id bigint, toxic int")
        grammar = toxicity.fit(table(spark, docs), labels)
        symbols = toxicity.Symbols(grammar.pieces)
        assert grammar.clauses("take your trash, they say", symbols) == []
        assert grammar.clauses("you moron", symbols) == [1.5]


class RunTagger:
    """Tags runs of x and at sign as e-mail addresses, as far as a window shows them."""

    def decode(self, x):
        run = (x == ord("x")) | (x == ord("@"))
        begins = run & ~np.pad(run, ((0, 0), (1, 0)))[:, :-1]
        path = np.where(begins, 1, np.where(run, 2, 0))
        path[:, 0] = np.where(run[:, 0], 2, 0)
        return path, np.ones(x.shape)


def test_pii_spans_that_window_edges_cut_are_joined():
    for size in (3, 47, 48, 49, 94, 95, 96, 97, 200, 400):
        for offset in range(1, 2 * pii.STRIDE + 2):
            for at in (1, size // 2, size - 2):
                span = "x" * at + "@" + "x" * (size - at - 1)
                text = "." * offset + span + "." * 150
                found = {f[:3] for f in pii.model_spans([text], RunTagger())[0]}
                assert found == {(0, offset, offset + size)}, (size, offset, at)


def test_pii_model_adds_short_phone_numbers_to_whole_documents(spark):
    draw = random.Random(12)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    some = lambda: " ".join(draw.choice(words) for _ in range(12))
    number = lambda: f"+{draw.randint(1, 9)} {draw.randint(100, 999)} {draw.randint(100, 999)}"
    tagger = pii.fit(table(spark, [(i, f"{some()} {number()} {draw.randint(1000, 9999)} {some()}", None, None) for i in range(700)]))
    texts = [(some() + " ", number()) for _ in range(50)]
    whole = [f"{before}{short} {some()}" for before, short in texts]
    added = 0
    for text, (before, short), found in zip(whole, texts, pii.model_spans(whole, tagger)):
        assert pii.base_spans(text) == []
        added += ("phone", len(before), len(before) + len(short)) in pii.reconciled(text, [], found)
    assert added >= 45


def brute_line_dedup(rows):
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        keep = [
            line for line in (text or "").split("\n")
            if len(key(line)) < 40 or len(holders[key(line)]) < 5 or (-1 if doc_id is None else doc_id) == max(holders[key(line)])
        ]
        out.append((doc_id, None if text is None else "\n".join(keep)))
    return out


def brute_near_dedup(rows):
    prints = [brute_fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, row in zip(group, rows):
        if g not in least or (row[0] is None, row[0] or 0) < (least[g][0] is None, least[g][0] or 0):
            least[g] = row
    return list(least.values())


def brute_decontamination(rows, items):
    windows = []
    for item in items:
        own = words_of(item)
        windows += [own[s : s + 10] for s in range(max(len(own) - 9, 1) if own else 0)]

    def hit(words):
        return any(words[p : p + len(w)] == w for w in windows for p in range(len(words) - len(w) + 1))

    return [row for row in rows if not hit(words_of(row[1]))]


def test_pipeline_stages_against_brute_force(spark, rows, tmp_path):
    item = " ".join(words_of(rows[9][1])[3:30])
    toxic = [(70, "you are an idiot. i will kill you", "en", "s1"), (71, "you scum. you moron", "en", "s2")]
    civil = [(72, "she said he would never kill them", "en", "s3"), (73, f"before that {item} and after", "en", "s0")]
    table(spark, [*rows, *toxic, *civil]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, item), (2, "no document has these words"), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(r[0], r[1]) for r in [*rows, *civil]]  # without labels, the default weights score
    wanted = [left]
    for brute in (brute_line_dedup, brute_near_dedup, lambda r: brute_decontamination(r, [i[1] for i in items])):
        left = brute(left)
        wanted.append(left)
    assert wanted[0] != wanted[1] and len(wanted[1]) > len(wanted[2]) > len(wanted[3])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.schema
    scores = toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert {r.doc_id for r in scores if r.score >= 0.7} == {70, 71}
    for (name, stage), expected in zip(corpus_pipeline.STAGES, wanted):
        after = stage(spark, docs, str(tmp_path))
        assert collected(after, "doc_id", "text") == sorted(expected, key=repr), name
        docs = spark.createDataFrame(after.collect(), columns)
    docs.write.parquet(f"{tmp_path}/left/documents.parquet")
    mixed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "size", "source_size", "target", "taken")
    assert differences(mixed, connect(f"{tmp_path}/left"), ORACLE["op4_mixing"]) == []


def test_every_language_is_learned_however_many_there_are(spark):
    name = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(3))
    docs = [(i, f"{name(i % 1100)} {name(i % 1100)}q", f"l{i % 1100:04d}", None) for i in range(6600)]
    docs += [(7000 + i, "aaa", "l0000", None) for i in range(50)]
    learned = {lang for i, _, lang, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(learned) > 1050
    found = {r.doc_id: r.lang_pred for r in language.identify(table(spark, docs), per_language=20, min_docs=1).collect()}
    assert all(found[i] == lang for i, _, lang, _ in docs if lang in learned)
    few = language.sample_rows(table(spark, docs), 20, total=1100)
    assert {r.lang for r in few.collect()} == learned
    assert few.count() < 2700
