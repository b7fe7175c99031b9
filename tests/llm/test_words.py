"""Hashes that tell words and texts apart, also those of regular patterns."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from auditloom.llm import known, words
from auditloom.llm.scratch import Scratch
from auditloom.llm.words import AS_IS, FIRST, SECOND, SPACED, byte_hashes, chunks, run_hashes, span_hashes

from tests.llm import test_decontaminate, test_near, test_substrings


def thue_morse(n, a="a", b="b"):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [[a, b][x] for x in bits], [[b, a][x] for x in bits]


def test_bytes_runs_and_spans():
    rng = np.random.default_rng(1)
    texts = {"".join(x) for n in (8, 64, 1024, 2048, 4096) for x in thue_morse(n)} | {"a" * n for n in range(1, 200)} | {"a" * n + "\0" for n in range(0, 130, 7)}
    texts |= {"".join(rng.choice(list("ab"), 20)) for _ in range(300)}
    texts = sorted(texts)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    for base in (FIRST, SECOND):
        hashes = byte_hashes(data, start, end, base)
        assert len(np.unique(hashes)) == len(texts)
        assert all(byte_hashes(np.frombuffer(b"xyz" + t.encode(), np.uint8), np.array([3]), np.array([3 + len(t)]), base)[0] == h for t, h in zip(texts, hashes, strict=True))
    values = rng.integers(0, 2, 500).astype(np.uint64)
    for n in (1, 2, 5, 8, 12, 35):
        got = run_hashes(values, n)
        seen = {}
        for i, h in enumerate(got.tolist()):
            assert seen.setdefault(h, values[i : i + n].tobytes()) == values[i : i + n].tobytes()
        assert len(seen) == len({values[i : i + n].tobytes() for i in range(len(got))}) and len(got) == 501 - n
    begin = rng.integers(0, 400, 300)
    stop = begin + rng.integers(0, 100, 300)
    got = span_hashes(values, begin, stop)
    assert len(set(got.tolist())) == len({values[a:b].tobytes() for a, b in zip(begin, stop, strict=True)})
    assert len(run_hashes(values[:3], 4)) == 0


def test_one_hash_for_all_parts_costs_time_only(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from auditloom.llm import bpe, token_files

    monkeypatch.setattr(words, "byte_hashes", lambda data, start, end, base=FIRST: np.full(len(start), 7, np.uint64))
    monkeypatch.setattr(token_files, "byte_hashes", words.byte_hashes)
    texts = ["one two three", "two one", "", "three three one four"]
    own, enc = bpe.Bpe(P.path("word_bpe_49k.json")), token_files.Encoder(P.path("byte_bpe_50k.json"), 2)
    for _ in range(2):
        n, ids, _ = own.digests(pa.array(texts))
        assert ids == [hashlib.sha256(" ".join(map(str, own.encode(t))).encode()).hexdigest() for t in texts] and n == [len(own.encode(t)) for t in texts]
        flat, counts = enc.encode(pa.array(texts))
        assert np.split(flat, np.cumsum(counts)[:-1])[1].tolist() == [*enc.tokenizer.encode("two one", add_special_tokens=False).ids, 2]
    assert known.Known is not None


def test_regular_words_in_the_tokenizers(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from auditloom.llm.bpe import bpe_digests
    from auditloom.llm.token_files import read_digests, write_tokens

    texts = ["".join(x) for n in (1024, 2048) for x in thue_morse(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in bpe_digests(docs, P.path("word_bpe_49k.json")).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, lib.encode(texts[r.doc_id], add_special_tokens=False).ids)).encode()).hexdigest()
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    manifest = write_tokens(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 2)
    for r in read_digests(spark, str(tmp_path / "t"), manifest).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes())


def test_regular_texts_are_different_texts(spark):
    pairs = [" ".join(x) for n in (128, 2048) for x in thue_morse(n, "a", "bc")] + [" ".join(thue_morse(8, "".join(x), "".join(y))[0]) for x, y in [thue_morse(1024), thue_morse(1024)[::-1]]]
    rows = list(enumerate(pairs))
    assert test_substrings.run(spark, rows) == test_substrings.brute(rows, 35)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from auditloom.llm.near import near_duplicates

    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, Scratch(spark, "tm")).collect()]
    assert sorted(got) == sorted(test_near.brute(rows))
    items = [(k, " ".join(x)) for k, x in enumerate(thue_morse(64, *("".join(x) for x in thue_morse(1024))))]
    from auditloom.llm.decontaminate import contamination

    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string")).drop("longest_match").collect()
    assert sorted(map(tuple, found)) == sorted(test_decontaminate.brute(rows, items))


def test_chunks_fingerprints_differ():
    a, b = (" ".join(x) for x in thue_morse(2048))
    (c,) = chunks(pa.array([a, b]), SPACED, AS_IS, limit=1 << 30)
    h = c.hashes()
    one, two = span_hashes(h, c.first[:-1], c.first[1:])
    assert one != two
