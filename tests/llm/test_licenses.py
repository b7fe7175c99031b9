import math
import random
import re

import numpy as np

from auditloom.llm.licenses import LEAST, PHRASES, SLACK, TEMPLATES, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "x MIT License y mit-license; MIT\nLICENSE", "Apache License, general public license", "mit licenses", "General Public\tLicense", "mit", None, "", "...",
    "éa mit license mit license", "word " * 3000 + "apache license", "general public public license",
] + [f"plain words number {i} of the text under test" for i in range(80)]


def brute(text):
    w = WORD.findall((text or "").translate(FOLD))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "z"), (None, TEXTS[1], "z")], "doc_id long, text string, labels string")
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[1] if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert scan_licenses(docs.limit(0)).count() == 0


def test_templates_found_and_near_misses_not(spark):
    rows = [(i, f"Some words of prose before it. {t} And more prose.") for i, (_, t, _) in enumerate(TEMPLATES)]
    rows += [(100, "the free software is in binary forms and a copy of this source"), (101, "permission is hereby denied to any person obtaining a copy of this software and associated documentation files")]
    rows += [(102, TEMPLATES[8][1].replace("without modification", "without any modification"))]
    rows += [(200 + i, f"prose number {i} about nothing at all") for i in range(600)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score > 0.99, (label, got[i])
    assert got[100].labels == got[101].labels == "" and got[102].labels == "bsd" and 0.6 <= got[102].score < 1
    assert all(got[200 + i].labels == "" and got[200 + i].score == 0 for i in range(600))


def test_notice_of_a_third_of_the_rows_is_found(spark):
    for label, notice, _ in (TEMPLATES[10], TEMPLATES[8], TEMPLATES[7]):
        rows = [(i, f"prose number {i} before it. {notice if i % 3 == 0 else ''} And more.") for i in range(300)]
        got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all((r.labels, r.score > 0.99) == ((label, True) if i % 3 == 0 else ("", False)) for i, r in got.items())


def test_notices_in_a_table_of_five_rows(spark):
    changed = TEMPLATES[8][1].replace("provided", "given")
    rows = [(0, TEMPLATES[8][1]), (1, f"see {TEMPLATES[10][1]}"), (2, "prose"), (3, None), (4, changed)]
    got = {r.doc_id: r.labels for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "cc-by-nc", 2: "", 3: "", 4: "bsd"}
    all_changed = scan_licenses(spark.createDataFrame([(i, changed) for i in range(5)], "doc_id long, text string")).collect()
    assert {r.labels for r in all_changed} == {"bsd"}


def test_texts_with_many_templates_have_all_of_them(spark):
    every, labels = [t for _, t, _ in TEMPLATES], sorted({x for x, _, _ in TEMPLATES})
    rare = " ".join(w for k in (1, 4, 7, 9, 12, 13) for w in WORD.findall(TEMPLATES[k][1].translate(FOLD))[::-1])
    rows = [(0, " ".join(every)), (1, "\n\n".join(reversed(every))), (2, " ".join(every[k] for k in (1, 8, 9)))]
    rows += [(10 + k, f"{rare} {'some more prose ' * 50} {t}") for k, t in enumerate(every)]
    # Words that only the long texts have are the rarest there.
    rows += [(100 + i, f"prose number {i} {every[i % 14] if i % 5 == 0 else ''}") for i in range(400)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].labels.split(",") == got[1].labels.split(",") == labels and got[2].labels == "bsd,isc,mit"
    assert all(label in got[10 + k].labels.split(",") and got[10 + k].score > 0.99 for k, (label, _, _) in enumerate(TEMPLATES))


def test_alignments_equal_a_search_of_all_places(spark):
    rng = np.random.default_rng(5)
    vocab = sorted({w for _, t, _ in TEMPLATES for w in WORD.findall(t.translate(FOLD))})
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 4)):
            own = WORD.findall(TEMPLATES[rng.integers(0, 14)][1].translate(FOLD))
            for _ in range(rng.integers(0, 6)):
                k = int(rng.integers(0, len(own)))
                own[k : k + int(rng.integers(0, 2))] = [str(x) for x in rng.choice(vocab, rng.integers(0, 2))]
            parts += own[rng.integers(0, 3) :] + [str(x) for x in rng.choice(vocab, rng.integers(0, 5))]
        texts.append(parts)
    df = {w: sum(w in t for t in texts) for w in vocab}
    idf = {w: np.log((len(texts) + 1) / (df[w] + 1)) + 1 for w in vocab}

    def search(text):
        labels, best = set(brute(" ".join(text))[4].split(",")) - {""}, 0.0
        for label, template, phrases in TEMPLATES:
            want = WORD.findall(template.translate(FOLD))
            total = sum(idf[w] for w in want)
            for s in range(-len(want), len(text)):
                def at(i):
                    return text[i] if 0 <= i < len(text) else None
                placed = sum(idf[w] for i, w in enumerate(want) if at(s + i) == w)
                score = (placed + sum(idf[w] for i, w in enumerate(want) if w in [at(s + i + d) for d in range(-4, 5)])) / (2 * total)
                if score < 0.6:
                    continue
                near = []
                for phrase in map(str.split, phrases):
                    where = next(i for i in range(len(want)) if want[i : i + len(phrase)] == phrase)
                    near.append(any(text[p : p + len(phrase)] == phrase for p in range(max(0, s + where - 4), s + where + 5)))
                if all(near):
                    labels, best = labels | {label}, max(best, min(score, 1.0))
        return ",".join(sorted(labels)), best

    rows = scan_licenses(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    want = [search(t) for t in texts]
    assert [r.labels for r in sorted(rows)] == [x for x, _ in want]
    assert np.allclose([r.score for r in sorted(rows)], [x for _, x in want])


def brute_labels(texts):
    """Every template laid at every place of every text; labels and the best score."""
    words = [WORD.findall((t or "").translate(FOLD)) for t in texts]
    idf = {w: math.log((len(words) + 1) / (sum(w in set(x) for x in words) + 1)) + 1 for _, t, _ in TEMPLATES for w in WORD.findall(t.translate(FOLD))}
    out = []
    for own in words:
        labels, best = set(), 0.0
        for label, t, mandatory in TEMPLATES:
            want = WORD.findall(t.translate(FOLD))
            phrases = [p.split() for p in mandatory]
            where = [next(i for i in range(len(want)) if want[i : i + len(p)] == p) for p in phrases]
            stand = [[i for i in range(len(own)) if own[i : i + len(p)] == p] for p in phrases]
            if not all(stand):
                continue
            total = math.fsum(idf[w] for w in want)
            at = {}
            for i, w in enumerate(own):
                at.setdefault(w, set()).add(i)
            for s in range(-len(want) + 1, len(own)):
                if not all(any(abs(i - s - x) <= SLACK for i in found) for found, x in zip(stand, where)):
                    continue
                placed = math.fsum(idf[w] for j, w in enumerate(want) if s + j in at.get(w, ()))
                moved = math.fsum(idf[w] for j, w in enumerate(want) if any(s + j + d in at.get(w, ()) for d in range(-SLACK, SLACK + 1)))
                if (score := (placed + moved) / (2 * total)) >= LEAST:
                    labels, best = labels | {label}, max(best, min(score, 1.0))
        out.append((labels | set(filter(None, brute(" ".join(own))[4].split(","))), best))
    return out


def test_labels_and_scores_equal_brute_force(spark):
    rng = random.Random(7)
    for size in (1, 12, 40):
        texts = []
        for _ in range(size):
            parts = []
            for _, t, _ in rng.sample(TEMPLATES, rng.randint(0, 3)):
                w = t.split()[:120]
                for _ in range(rng.choice([0, 0, 1, 3, len(w) // 5])):
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], ["other"], [w[k], "more"]])
                    w = w or ["x"]
                parts += rng.choices(["some", "prose", "the", "license", "of", "mit"], k=rng.randint(0, 9)) + w
            texts.append(" ".join(parts))
        texts += [None, "", TEMPLATES[8][1]]
        got = sorted(scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
        want = brute_labels(texts)
        assert [r.labels for r in got] == [",".join(sorted(x)) for x, _ in want]
        assert np.allclose([r.score for r in got], [x for _, x in want], atol=1e-9)
