import hashlib
import re

import numpy as np

from auditloom.llm.decontaminate import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(rows, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(len(w), 8)
        windows += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def holding(rows, items):
    """Documents with 8 consecutive words of an item, or windows of two items."""
    found = {r[0] for r in brute(rows, items) if r[5]}
    for _, text in items:
        w = words(text)
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for doc_id, t in rows:
            d = words(t)
            if own & {tuple(d[i : i + 8]) for i in range(len(d) - 7)}:
                found.add(doc_id)
    return found


def cases():
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve"]

    def prose(n):
        return [str(x) for x in rng.choice(vocab, n)]

    items = [(i, " ".join(prose(n))) for i, n in enumerate((30, 12, 8, 9, 20, 25))]
    items += [(20, items[0][1]), (21, "zebra quagga okapi"), (22, "..."), (23, None), (24, ""), (25, "lone"), (None, "a b c d e f g h i")]
    rows = []
    for i in range(40):
        parts = prose(rng.integers(0, 60))
        for _ in range(rng.integers(0, 3)):
            w = items[rng.integers(0, 6)][1].upper().split()
            parts += w[rng.integers(0, 4) :] + prose(rng.integers(0, 10))
        rows.append((i, ["-", " ", "\n, "][i % 3].join(parts)))
    rows += [(50, None), (51, ""), (52, "!!"), (53, "Zebra, quagga; OKAPI!"), (54, "x lone x lone"), (3, rows[3][1]), (None, items[1][1]), (55, "a b c d e f g h i"), (56, " ".join(prose(9000) + [items[4][1]]))]
    return rows, items


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, item_id string, n_hit int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def got(frame):
    return sorted([tuple(r) for r in frame.drop("longest_match").collect()], key=str)


def test_equals_brute_force_in_one_and_many_blocks(spark):
    rows, items = cases()
    docs, bench = frames(spark, rows, items)
    want = brute(rows, items)
    assert got(contamination(docs, bench)) == want
    assert got(contamination(docs, bench, block_size=300)) == want


def test_longest_match(spark):
    docs, bench = frames(spark, [(1, "x y " + " ".join("abcdefghijkl") + " z")], [(7, " ".join("bcdefghijk")), (8, " ".join("cdefghijklmnop"))])
    r = contamination(docs, bench).first()
    assert (r.longest_match.length, r.longest_match.word, r.longest_match.item) == (10, 3, 7)


def test_removal_keeps_columns(spark):
    rows, items = cases()
    docs, bench = frames(spark, rows, items)
    bad = holding(rows, items)
    kept = decontaminate(docs, bench)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in bad or i is None and None not in bad)


def test_empty_tables(spark):
    rows, items = cases()
    docs, bench = frames(spark, rows, items)
    assert got(contamination(docs.limit(0), bench)) == []
    assert got(contamination(docs, bench.limit(0))) == brute(rows, [])


def test_longest_match_is_over_all_items_that_share_a_header(spark):
    rng = np.random.default_rng(4)
    header = [f"h{i}" for i in range(100)]
    items = [(i, header + [f"q{x}" for x in rng.integers(0, 3, 60)]) for i in range(20)]
    rows = [(i, ["x"] + w + ["y"]) for i, w in items] + [(100 + i, w[:130] + ["x"] + w[90:150]) for i, w in items] + [(200 + i, w[100:120]) for i, w in items]
    docs, bench = frames(spark, [(i, " ".join(w)) for i, w in rows], [(i, " ".join(w)) for i, w in items])

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    text, item = dict(rows), dict(items)
    for r in contamination(docs, bench).collect():
        m, w = r.longest_match, text[r.doc_id]
        assert m.length == max(common(w[p:], b[q:]) for _, b in items for p in range(len(w)) for q in range(len(b)) if w[p] == b[q])
        assert any(item[m.item][q : q + m.length] == w[m.word : m.word + m.length] for q in range(160))
        assert r.doc_id >= 100 or (m.length, m.word, m.item) == (160, 1, r.doc_id)
