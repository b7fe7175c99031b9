import math
import re

import numpy as np
import pyarrow as pa

from auditloom.llm.quality import FUNCTION_WORDS, LABELLERS, estimate, pattern, posterior, quality_rows, slots, train, votes
from auditloom.llm.words import LOWER, SPACED, chunks


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, accuracy, voting = 40_000, np.array([0.95, 0.85, 0.75, 0.9]), np.array([0.9, 0.8, 1.0, 0.5])
    truth = rng.random(n) < 0.8
    right = rng.random((n, 4)) < accuracy
    v = np.where(rng.random((n, 4)) < voting, np.where(right == truth[:, None], 2, 1), 0)
    keys, counts = np.unique(pattern(v), return_counts=True)
    prior, got = estimate(dict(zip(keys.tolist(), counts.tolist(), strict=True)), 4)
    assert abs(prior - 0.8) < 0.02 and np.allclose(got, accuracy, atol=0.03)
    assert np.mean((posterior(v, prior, got) > 0.5) == truth) > 0.93
    assert estimate({}, len(LABELLERS))[0] == 0.7


def rows():
    rng = np.random.default_rng(6)
    content = [f"{a}{b}{c}" for a in ("ka", "mo", "ti") for b in ("lu", "ren", "sa") for c in ("do", "x", "vin", "")]

    def prose(n):
        return ["the" if x < 0.12 else "of" if x < 0.2 else "and" if x < 0.27 else str(rng.choice(content)) for x in rng.random(n)]

    out = []
    for i in range(400):
        w = prose(rng.integers(20, 150))
        kind = i % 10
        if kind == 0:
            text = " ".join(f"{x}{rng.choice(['###', '&&&', '%%%'])}" for x in w)
        elif kind == 1:
            text = " ".join(f"{x.upper()}!!" for x in w)
        elif kind == 2:
            text = " ".join([str(rng.choice(content))] * len(w))
        elif kind == 3:
            text = " | ".join(x for x in w if x in content)
        else:
            text = ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)) + "."
        out.append((i, text, kind > 3))
    return out


def test_junk_goes_and_prose_stays(spark):
    data = rows()
    odd = [(1000, None, False), (1001, "", False), (1002, " \n", False), (None, data[5][1], True), (5, data[5][1], True), (1003, "the end of it " * 5000, True)]
    docs = spark.createDataFrame([(i, t, 0.1, "b") for i, t, _ in data + odd], "doc_id long, text string, score double, posterior string")
    got = quality_rows(docs).collect()
    assert len(got) == len(data) + len(odd)
    by_id = {r.doc_id: r for r in got}
    good = [by_id[i].kept for i, _, ok in data if ok]
    bad = [not by_id[i].kept for i, _, ok in data if not ok]
    assert np.mean(good) > 0.99 and np.mean(bad) > 0.95
    for i in (1000, 1001, 1002):
        assert (by_id[i].score, by_id[i].posterior, by_id[i].kept) == (0.0, 0.0, False)
    assert by_id[None].score == by_id[5].score and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rows(docs).count() == 0
    assert [r.kept for r in quality_rows(spark.createDataFrame([(1, None)], docs.schema)).collect()] == [False]


SYMBOLS = b"#$%&*@^~<>|{}[]\\=+_"


def brute_votes(text):
    """What each labeller says of a text, word by word; None without words."""
    raw = re.findall(rb"[^ \t-\r]+", text.encode())
    if not raw:
        return None
    words, every = [w.lower() for w in raw], b"".join(raw)
    letters = sum(b >= 0x80 or chr(b).isalpha() for b in every)
    echoes = [any(i >= j and words[i] == words[i - j] for j in (1, 2, 3, 4)) for i in range(len(words))]
    known = {x.encode() for x in FUNCTION_WORDS}
    share = {
        "repeats": sum(i > 0 and words[i] == words[i - 1] for i in range(len(words))), "echoes": sum(echoes), "shouts": sum(w.endswith(b"!") for w in raw),
        "functions": sum(w in known and not e for w, e in zip(words, echoes)), "bars": sum(w == b"|" for w in raw), "marked": sum(w[-1] in SYMBOLS and len(w) > 1 for w in raw),
    }
    found = {k: n / len(words) if len(words) >= 8 else None for k, n in share.items()}
    found |= {"symbols": sum(b in SYMBOLS for b in every) / len(every), "oddities": 1 - letters / len(every), "capitals": sum(0x41 <= b <= 0x5A for b in every) / letters if letters else None}
    out = []
    for name, bad, good in LABELLERS:
        x, up = found[name], good is None or bad > good
        is_bad = x is not None and (x >= bad if up else x <= bad)
        is_good = x is not None and good is not None and (x <= good if up else x >= good)
        out.append("bad" if is_bad else "good" if is_good else "")
    return out


def brute_estimate(said):
    """Expectation-maximisation text by text."""
    prior, accuracy = 0.7, [0.8] * len(LABELLERS)

    def good(v):
        yes, no = prior, 1 - prior
        for x, a in zip(v, accuracy):
            yes, no = (yes * a, no * (1 - a)) if x == "good" else (yes * (1 - a), no * a) if x == "bad" else (yes, no)
        return yes / (yes + no)

    for _ in range(100):
        p = [good(v) for v in said]
        new = []
        for k in range(len(LABELLERS)):
            right = math.fsum(q if v[k] == "good" else 1 - q if v[k] == "bad" else 0 for v, q in zip(said, p))
            new.append(max((right + 8) / (sum(v[k] != "" for v in said) + 10), 0.5))
        prior, accuracy = (math.fsum(p) + 1) / (len(said) + 2), new
    return prior, accuracy, good


def test_posteriors_equal_brute_force_over_all_texts(spark):
    data = [(i, t) for i, t, _ in rows()] + [(900, None), (901, ""), (902, " \v"), (903, "ÀÉ ü! | || the der"), (904, "THE OF | the | of | ###"), (5, rows()[5][1])]
    got = quality_rows(spark.createDataFrame(data, "doc_id long, text string")).collect()
    said = [v for _, t in data if (v := brute_votes(t or ""))]
    _, _, good = brute_estimate(said)
    want = sorted((i, good(v) if (v := brute_votes(t or "")) else 0.0) for i, t in data)
    assert len({tuple(v) for v in said}) > 5
    assert [i for i, _ in want] == sorted(r.doc_id for r in got) and np.allclose([p for _, p in want], [r.posterior for r in sorted(got, key=lambda r: (r.doc_id, r.posterior))], atol=1e-9)


def test_scorer_equals_brute_force():
    """Training and scoring feature by feature, with dictionaries in place of arrays."""
    texts = [t for _, t, _ in rows()[:24]] + ["", "one"]
    accuracy = np.linspace(0.6, 0.95, len(LABELLERS))
    features, labels = [], []
    for text in texts:
        (c,) = chunks(pa.array([text]), SPACED, LOWER)
        if c.counts[0]:
            features.append(slots(c, c.hashes()).tolist())
            labels.append(float(posterior(votes(c, c.hashes()), 0.6, accuracy)[0]))
    weights, seen, bias, seen_b = {}, {}, 0.0, 1e-8

    def probability(words):
        return 1 / (1 + math.exp(-(bias + math.fsum(weights.get(s, 0.0) for w in words for s in w) / len(words))))

    for _ in range(60):
        errors = [(probability(f) - y) / len(labels) for f, y in zip(features, labels)]
        grad = {s: 1e-6 * x for s, x in weights.items()}
        for f, e in zip(features, errors):
            for w in f:
                for s in w:
                    grad[s] = grad.get(s, 0.0) + e / len(f)
        for s, g in grad.items():
            seen[s] = seen.get(s, 1e-8) + g * g
            weights[s] = weights.get(s, 0.0) - 0.5 * g / math.sqrt(seen[s])
        seen_b += sum(errors) ** 2
        bias -= 0.05 * sum(errors) / math.sqrt(seen_b)
    scorer = train(texts, 0.6, accuracy)
    assert abs(scorer.bias - bias) < 1e-6 and set(np.flatnonzero(scorer.weights).tolist()) <= set(weights)
    assert max(abs(float(scorer.weights[s]) - x) for s, x in weights.items()) < 1e-5
