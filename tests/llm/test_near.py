import re
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import near
from auditloom.llm.components import components
from auditloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def reach(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in range(n):
        groups[root(x)].append(x)
    return [groups[root(x)] for x in range(n)]


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    out = []
    for (doc_id, _), s, group in zip(rows, sets, reach(len(rows), links), strict=True):
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        out.append((doc_id, len(s), least if s else doc_id, doc_id == least if s else True))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string")
    return sorted([tuple(r) for r in near.near_duplicates(docs, Scratch(spark, "t")).drop("th", "group").collect()], key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.integers(0, len(out))] = f"E{rng.integers(0, 10**9)}"
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [[str(x) for x in rng.choice(vocab, 120)] for _ in range(4)]
    rows, k = [], 0
    for b, copies in zip(base, (90, 12, 5, 2), strict=True):
        for _ in range(copies):
            rows.append((k, " ".join(edited(rng, b, rng.integers(0, 7)))))
            k += 1
    rows += [(500 + i, rows[0][1].upper()) for i in range(20)]
    rows += [(600, None), (601, ""), (602, " \t"), (603, "a b c"), (604, "A  B c"), (605, "a b"), (0, rows[3][1]), (None, rows[5][1]), (None, "alone without any id at all"), (606, None)]
    rows += [(700 + i, " ".join(str(x) for x in rng.choice(vocab, 80))) for i in range(10)]
    rows += [(800, "x " * 4000), (801, "x " * 9)]
    return rows


def test_equals_brute_force(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_blocks_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "PAIRS", 3)
    monkeypatch.setattr(near, "BLOCK", 16)
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_components_of_long_paths(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(200).tolist()
    links = [(names[i], names[i + 1]) for i in range(0, 120)] + [(names[130 + i], names[130]) for i in range(1, 40)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "c"), "c").collect()}
    want = reach(200, links)
    assert got == {x: min(want[x]) for x in range(200) if len(want[x]) > 1}
