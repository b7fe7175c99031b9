import itertools
import re
import zlib

import numpy as np
import pytest

from auditloom.llm import language
from auditloom.llm.language import fit, forward_backward, identify, keep_identified, language_rows

SOUNDS = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "elt", "und", "ö"], "cc": ["çao", "ñe", "ux", "ié"]}


def prose(rng, lang, n):
    return ["".join(rng.choice(SOUNDS[lang], rng.integers(1, 4))) for _ in range(n)]


def test_forward_backward_equals_enumeration(monkeypatch):
    monkeypatch.setattr(language, "STEP", 3)
    rng = np.random.default_rng(1)
    counts = [1, 0, 7, 3, 4, 0, 6]
    first = np.concatenate([[0], np.cumsum(counts)])
    scores, trans = rng.normal(size=(first[-1], 3)) * 2, rng.normal(size=(3, 3))
    got = forward_backward(scores, trans, first)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        # The start is uniform and takes one transition.
        total = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.log(np.exp(trans[:, path[0]]).sum()) + scores[a + np.arange(b - a), path].sum() + sum(trans[x, y] for x, y in zip(path, path[1:]))
            for t, y in enumerate(path):
                total[t, y] += np.exp(w)
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join(prose(rng, lang, rng.integers(5, 200))).title(), lang))
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 — …", None), (903, "日本", None), (904, " ".join(prose(rng, "bb", 30000)), None), (None, "kamo tiru", None), (5, rows[5][1], "cc")]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy_and_odd_rows(spark, rows):
    got = language_rows(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: lang for i, _, lang in rows[:240]}
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[902].score == 0
    assert by_id[903].lang_pred in want.values() and by_id[904].lang_pred == "bb" and by_id[None].lang_pred == "aa"


def test_code_switching(spark, rows):
    docs = frame(spark, rows)
    rng = np.random.default_rng(9)
    mixed = spark.createDataFrame([(1, " ".join(prose(rng, "aa", 30) + prose(rng, "cc", 20)))], "doc_id long, text string")
    runs = identify(mixed, fit(docs), with_runs=True).first()._runs
    assert runs[0].lang == "aa" and runs[-1].lang == "cc" and runs[-1].stop == 50
    assert sum(r.stop - r.first for r in runs if r.lang == "aa") in range(27, 34)


def test_stage_and_empty_tables(spark, rows):
    docs = frame(spark, rows)
    kept = keep_identified(docs)
    assert kept.schema == docs.schema and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() == len(rows) - 3
    assert language_rows(docs.limit(0)).count() == 0
    unlabelled = spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_rows(unlabelled).collect()} == {"und"}


def test_stage_keeps_texts_of_many_languages_and_unlabelled_tables(spark, rows):
    rng = np.random.default_rng(11)
    SOUNDS["dd"] = ["wyż", "qo", "pfy", "xen"]
    more = [(2000 + i, " ".join(prose(rng, "dd", rng.integers(5, 200))).title(), "dd") for i in range(80)]
    mixed = [(3000 + i, " ".join(w for lang in SOUNDS for w in prose(rng, lang, 25)), None) for i in range(5)]
    del SOUNDS["dd"]
    kept = {r.doc_id for r in keep_identified(frame(spark, rows + more + mixed)).collect()}
    assert {i for i, _, _ in mixed} <= kept and {900, 901, 902}.isdisjoint(kept)
    # No labels at all, and none outside of the held-out share.
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2]
    for some in ([(i, t, None) for i, t, _ in rows], [(i, "kamo tiru", "aa") for i in held] + rows[-7:-4] + [(2, "...", None)]):
        docs = spark.createDataFrame([(*r, "s", 0.5) for r in some if r[0] not in (900, 901)] + [(900, None, None, "s", 0.5), (901, "", None, "s", 0.5)], frame(spark, rows).schema)
        stage = keep_identified(docs)
        want = sum(t is not None and any(map(str.isalpha, t)) for i, t, _ in some if i not in (900, 901))
        assert stage.schema == docs.schema and stage.count() == want > 0


def test_pair_counts_equal_enumeration(monkeypatch):
    monkeypatch.setattr(language, "STEP", 3)
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 8, 8, 13])
    scores, trans = rng.normal(size=(13, 3)) * 2, rng.normal(size=(3, 3)) * 2
    want = np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        total, pairs = 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(np.log(np.exp(trans[:, path[0]]).sum()) + scores[a + np.arange(b - a), path].sum() + sum(trans[x, y] for x, y in zip(path, path[1:]))) if b > a else 1.0
            total += w
            for x, y in zip(path, path[1:]):
                pairs[x, y] += w
        want += pairs / total
    forward = np.empty_like(scores)
    p = forward_backward(scores, trans, first, forward)
    at = np.setdiff1d(np.arange(12), first[1:] - 1)
    assert np.allclose(language.pair_counts(p, forward, trans, at), want)


def test_every_one_of_many_labels_is_learned_from(spark, monkeypatch):
    rows = [(i, f"word{i} text", f"l{i % 230}") for i in range(230 * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    monkeypatch.setattr(language, "train", lambda texts, langs: langs)
    assert len(want) > 200 and set(fit(docs)) == want
    few = fit(docs, sample=460)
    assert set(few) == want and len(few) <= 460 and set(fit(docs, sample=1)) == want


def test_probabilities_in_parts_equal_the_whole():
    rng = np.random.default_rng(6)
    labels = [f"l{i}" for i in range(210)]
    model = language.Model("parts", labels, rng.normal(size=(language.FEATURES, 210)).astype(np.float32), np.clip(rng.normal(size=(210, 210)), -8, 0), np.zeros(0, np.uint64))
    (c,) = language.words_of(language.pa.array([" ".join(prose(rng, "aa", n)) for n in (3, 0, 1200, 700, 6500, 1, 64)]))
    got = language.probabilities(c, model)
    slots, begin = language.features(c.folded, c.start, c.end, c.hashes(), model.lexicon)
    assert np.allclose(got, forward_backward(language.emissions(model.weights, slots, begin).astype(np.float64), model.transitions, c.first), atol=1e-5)


def test_rows_equal_brute_force(spark, rows):
    """Each word's features by itself, sums over all ways through a text in logarithms, means word by word."""
    model = fit(frame(spark, rows))
    some = [r for r in rows if r[0] is None or r[0] % 6 == 0 or r[0] >= 900 and r[0] != 904] + [(5000, "x", None), (5001, "Ka ka-KA 77 ÇAO", None), (5002, "1 2 3", None)]
    got = {(r.doc_id, r.text): r for r in identify(frame(spark, some), model).collect()}
    assert len(got) == len(some)

    def logsum(x):
        top = max(x)
        return top + np.log(sum(np.exp(v - top) for v in x))

    def scores_of(word):
        (c,) = language.words_of(language.pa.array([word]))
        slots, begin = language.features(c.folded, c.start, c.end, c.hashes(), model.lexicon)
        one = language.emissions(model.weights, slots, begin)
        assert len(one) == 1
        return one[0].astype(float).tolist()

    n, t = range(len(model.labels)), model.transitions.tolist()
    for doc_id, text, _ in some:
        words = [w for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text or "")]
        r = got[(doc_id, text)]
        if not any(map(str.isalpha, text or "")):
            assert (r._pred, r._score, r._lettered) == ("und", 0.0, False)
            continue
        e = [scores_of(w) for w in words]
        ahead = [[logsum([t[x][y] for x in n]) + e[0][y] for y in n]]
        for own in e[1:]:
            ahead.append([logsum([ahead[-1][x] + t[x][y] for x in n]) + own[y] for y in n])
        back = [[0.0 for _ in n]]
        for own in e[:0:-1]:
            back.insert(0, [logsum([t[x][y] + own[y] + back[0][y] for y in n]) for x in n])
        total = logsum(ahead[-1])
        mean = [sum(np.exp(a[y] + b[y] - total) for a, b in zip(ahead, back)) / len(words) for y in n]
        assert r._pred == model.labels[int(np.argmax(mean))] and abs(r._score - max(mean)) < 1e-4, (doc_id, r._score, mean)
