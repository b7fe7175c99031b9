import hashlib
import re
from collections import Counter

import numpy as np

import pyarrow as pa

from auditloom.llm.scratch import Scratch
from auditloom.llm.substrings import _kept, compacted, substring_digests

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        spans, i = [], 0
        while i < len(w):
            j = i
            while j < len(w) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = max(j, i + 1)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans))
    return sorted(out, key=str)


def run(spark, rows, k=35):
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in rows], "doc_id long, text string, copies int, t1 string")
    got = substring_digests(docs, Scratch(spark, "t"), k).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, [tuple(s) for s in r.removed_spans]) for r in got], key=str)


def test_planted_repeats(spark):
    rng = np.random.default_rng(11)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]

    def prose(n):
        return [str(x) for x in rng.choice(vocab, n)]

    passages = [prose(n) for n in (34, 35, 36, 50, 120, 35)]
    rows = []
    for i in range(60):
        parts = prose(rng.integers(0, 90))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(0, 6)]
            cut = rng.integers(0, 12)
            parts += p[cut:] + prose(rng.integers(0, 30))
        sep = ["\t", " ", "\n  "][i % 3]
        rows.append((i, sep.join(parts)))
    edited = rows[5][1].split()
    if len(edited) > 50:
        edited[40] = "edit"
    rows += [(100, rows[3][1]), (101, " ".join(WORD.findall(rows[3][1]))), (102, " ".join(edited)), (3, rows[3][1])]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "a b"), (203, "x " * 34), (204, "same " * 90), (205, " ".join(passages[4] * 2)), (206, " ".join(prose(5000) + passages[3]))]
    assert run(spark, rows) == brute(rows, 35)


def test_few_different_words(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["a", "b"], rng.integers(0, 120)))) for i in range(40)]
    assert run(spark, rows, 14) == brute(rows, 14)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == brute([(1, None)], 35)


def brute_paths(edges):
    """The nonbranching paths of edges (name, u, v) that have a beginning."""
    into, out = {}, {}
    for e, u, v in edges:
        out.setdefault(u, []).append(e)
        into.setdefault(v, []).append(e)
    inner = {x for x in out if len(out[x]) == 1 and len(into.get(x, ())) == 1}
    ends = {e: (u, v) for e, u, v in edges}
    found = []
    for e, (u, _) in ends.items():
        if u not in inner:
            path = [e]
            while ends[path[-1]][1] in inner:
                path.append(out[ends[path[-1]][1]][0])
            found.append(tuple(path))
    return sorted(found)


def test_paths_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    k, homes = 6, {}
    texts = [rng.integers(0, 3, rng.integers(10, 90)).tolist() for _ in range(25)] + [[0, 1, 2, 3, 4, 5] * 4, list(range(10, 400)), [*range(100, 140), *range(700, 730)], [8] * 30]
    for t, w in enumerate(texts):
        for i in range(len(w) - k + 1):
            # Strands of up to 5 edges.
            homes.setdefault(tuple(w[i : i + k]), (t * 100 + i // 5) * k + i % 5)
    names = {e: n for n, e in enumerate(sorted(homes))}
    nodes = {x: n for n, x in enumerate(sorted({e[:-1] for e in names} | {e[1:] for e in names}))}
    edges = [(n, nodes[e[:-1]], nodes[e[1:]]) for e, n in names.items()]
    rows = [(n, 0, homes[e], nodes[e[:-1]], nodes[e[1:]], 1) for e, n in names.items()]
    pieced, pieces = compacted(spark.createDataFrame(rows, "e1 long, e2 long, home long, u long, v long, n int"), Scratch(spark, "t"), k)
    place = {r.piece: (r.path, r.off) for r in pieces.collect()}
    found = {}
    for r in pieced.collect():
        path, off = place[r.piece]
        found.setdefault(path, []).append((off + r.i, r.e1))
    paths = []
    for path in found.values():
        assert [i for i, _ in sorted(path)] == list(range(len(path)))
        paths.append(tuple(e for _, e in sorted(path)))
    want = brute_paths(edges)
    circles = set(names.values()) - {e for p in want for e in p}
    assert circles and sorted(p for p in paths if p[0] not in circles) == want and max(map(len, want)) > 200


def test_stretches_with_other_words_stay():
    kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("skip", pa.int32()), ("path_words", pa.string())]))
    text = "a b c d e f g h"
    for path, skip, removed in (("a b c d", 0, 4), ("x a b c d", 1, 4), ("a b c x", 0, 0), ("a bb c d", 0, 0), ("a b cd d", 0, 0)):
        batch = pa.RecordBatch.from_pydict({"t1": [1], "t2": [2], "words": [text], "stretches": pa.array([[{"at": 0, "n": 2, "skip": skip, "path_words": path}]], kind)})
        (out,) = _kept([batch], 3)
        assert out.column("n_removed").to_pylist() == [removed] and out.column("kept").to_pylist() == [" ".join(text.split()[removed:])]
