import hashlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from tests.llm import test_decontaminate, test_near, test_substrings  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(12)
    vocab = {"en": [f"the{a}{b}" for a in "abcdefgh" for b in ("ing", "ed", "th", "ous", "")], "fr": [f"é{a}{b}" for a in "abcdefgh" for b in ("aux", "ième", "oir", "ç", "")]}

    def prose(lang, n):
        return [str(x) for x in rng.choice(vocab[lang], n)]

    items = [(i, " ".join(prose("en", 14))) for i in range(6)]
    passage = prose("fr", 60)
    rows = []
    for i in range(60):
        lang = ["en", "fr"][i % 2]
        w = prose(lang, rng.integers(60, 160))
        if i % 10 == 3:
            w = w[:20] + passage + w[20:]
        if i % 15 == 4:
            w = w + items[i % 6][1].split() + w[:5] + items[(i + 1) % 6][1].split()
        if i % 15 == 6:
            w = w + items[0][1].split()
        rows.append((i, " ".join(w), lang))
    near = rows[8][1].split()
    near[7] = "changed"
    rows += [(100, rows[2][1], "en"), (101, " ".join(near), "en"), (102, None, None), (103, "... 123 !", "en"), (104, "", "fr"), (8, rows[8][1], "en")]
    return rows, items


def stages(spark, rows, items, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in rows], SCHEMA)
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet")


def pairs(frame):
    return sorted([(r.doc_id, r.text) for r in frame.collect()], key=str)


def test_every_stage_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    folder, docs = stages(spark, rows, items, tmp_path)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs(docs)
        after = stage(spark, docs, folder)
        if k < 4:
            assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in docs.schema]
            after.write.mode("overwrite").parquet(f"{folder}/{name}")
            after = spark.read.parquet(f"{folder}/{name}")
        if name == "language":
            assert pairs(after) == [x for x in before if x[0] not in (102, 103, 104)]
        elif name == "near_duplicates":
            want = {i for i, _, _, kept in test_near.brute(before) if kept}
            assert {x[0] for x in pairs(after)} == want and 100 not in want and 101 not in want and len(pairs(after)) == len(want)
        elif name == "substrings":
            sha = {(r[0], r[3]): r[2] for r in test_substrings.brute(before, 35)}
            assert any(sha.values()) and len(pairs(after)) == len(before)
            old = dict(before)
            for i, text in pairs(after):
                removed = sha[i, hashlib.sha256(text.encode()).hexdigest()]
                assert removed or text == old[i]
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "benchmark":
            one = {r[0] for r in test_decontaminate.brute(before, items) if r[3] == 1}
            bad = test_decontaminate.holding(before, items)
            assert one & bad and pairs(after) == [x for x in before if x[0] not in bad]
        else:
            assert sorted(r.doc_id for r in after.collect()) == sorted(x[0] for x in before)
        docs = after
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert whole == sorted(map(tuple, docs.collect()))


def test_benchmark_stage_alone(spark, tmp_path):
    rows, items = corpus()
    items = [*items, (90, "short item"), (91, "three more words"), (92, None), (93, "")]
    rows = [(i, t, lang) for i, t, lang in rows] + [(200, "a short item here", "en"), (201, "short item and three more words", "en"), (202, "x " * 40_000 + items[2][1], "en"), (203, "x " * 40_000, "en")]
    folder, docs = stages(spark, rows, items, tmp_path)
    before, bad = pairs(docs), test_decontaminate.holding([(i, t) for i, t, _ in rows], items)
    assert {201, 202} <= bad and not {200, 203, 102, 104} & bad
    assert pairs(corpus_pipeline.benchmark(spark, docs, folder)) == [x for x in before if x[0] not in bad]
    folder, docs = stages(spark, rows, items[:0] or [(0, None)], tmp_path)
    assert pairs(corpus_pipeline.benchmark(spark, docs, folder)) == before
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    assert pairs(corpus_pipeline.benchmark(spark, docs, folder)) == before


def test_empty_documents(spark, tmp_path):
    folder, _ = stages(spark, [], corpus()[1], tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_columns_of_any_name_pass_through(spark, tmp_path):
    rows, items = corpus()
    folder, docs = stages(spark, rows, items, tmp_path)
    names = ["_pred", "_score", "_items", "_n_words", "_t1", "_kept", "_id", "_th", "_id0", "th", "group", "component id", "a.b"]
    wide = docs.selectExpr("*", *[f"doc_id as `{n}`" for n in names]).drop("source")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, wide, folder)
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in wide.schema]
        assert all(r[n] == r["doc_id"] for r in after.collect() for n in names)
