import math

import numpy as np

from auditloom.llm.scratch import Scratch
from auditloom.llm.vectors import close_pairs, near_vectors


def brute(rows):
    def usable(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    group, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                x, y = (np.array(v, float) / max(map(abs, v)) for v in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    out = []
    for i, (vec_id, v) in enumerate(rows):
        least = min((rows[k][0] for k in range(n) if group[k] == group[i] and rows[k][0] is not None), default=None) if usable(v) else vec_id
        out.append((vec_id, links[i], least, vec_id == least))
    return sorted(out, key=str)


def run(spark, rows, size):
    frame = spark.createDataFrame([(i, v, 3, i) for i, v in rows], "vec_id long, embedding array<float>, label int, node long")
    return sorted([tuple(r) for r in near_vectors(frame, Scratch(spark, "t"), size=size).collect()], key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        centre = rng.normal(size=20)
        for _ in range((60, 20, 10, 5, 2, 1)[c]):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=20) * 0.19]))
    rows += [(1000 + k, [float(np.float32(x)) for x in rng.normal(size=20)]) for k in range(30)]
    rows += [(2000 + k, rows[3][1]) for k in range(12)] + [(2100, [2 * x for x in rows[3][1]]), (3, rows[3][1]), (None, rows[5][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [float("nan")] + [1.0] * 19), (3004, [None] + [1.0] * 19), (3005, [float("inf")] * 20), (3006, [1.0, 0.0]), (3007, [1.0, 0.1]), (3008, [1e-30] * 20), (3009, [1e30] * 20)]
    want = brute(rows)
    assert run(spark, rows, 16) == want
    assert run(spark, rows, 2048) == want


def test_empty(spark):
    assert run(spark, [], 8) == []
    assert run(spark, [(1, None), (2, [0.0])], 8) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 100))
    y = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.2, 0.3, 0.33, 0.5)])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    i, j, p = close_pairs(y, y, 0.95)
    found = {(a, b) for a, b, c in zip(i.tolist(), j.tolist(), p.tolist(), strict=True) if c >= 0.95}
    assert found == set(zip(*(x.tolist() for x in np.nonzero(y @ y.T >= 0.95)), strict=True))
