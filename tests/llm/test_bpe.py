import hashlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from auditloom.llm import bpe as module  # noqa: E402
from auditloom.llm.bpe import Bpe, bpe_digests, bpe_tokens  # noqa: E402

TEXTS = [
    "", " ", "a", "Hello, World's we'll 123", "ΣΑΣ ΌΣΟΣ İstanbul ǅ", "日本語　テスト x", "é é ñ̃", "a<|endoftext|>B <|startoftext|>", "\x1c\x1d x\x85y z",
    "naïve café", "x" * 3000, "😀😀 ok! ...", "AaBb" * 500, "́ lone", "don't'll''s",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_ids_and_decoding_equal_the_library():
    own, lib = Bpe(P.path("word_bpe_49k.json")), library()
    rng = np.random.default_rng(3)
    alphabet = list("abcdeXYZ'stll 19\n\t  !?é́日Σß\x1f") + ["<|endoftext|>", "the", "ing"]
    texts = TEXTS + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(1500)]
    for text in texts:
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, text
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False), text


def test_query_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "CACHE", 5)
    monkeypatch.setattr(module, "SPANS", 5)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (50, None, 1), (None, "x y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe_digests(docs, P.path("word_bpe_49k.json")).collect()
    lib = library()
    want = []
    for doc_id, text, _ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.doc_id: r.ids for r in bpe_tokens(docs, P.path("word_bpe_49k.json")).collect()}[2] == lib.encode("a", add_special_tokens=False).ids
    assert bpe_digests(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0
