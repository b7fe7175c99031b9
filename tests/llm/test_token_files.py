import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from auditloom.llm.token_files import Encoder, Shard, read_digests, write_tokens  # noqa: E402

TEXTS = [
    "", "a", "  two  spaces ", "tab\tand\nnew  \n\n lines\r\n", "it's we'll I'D 12 345", "日本語 テスト　全角 x", "é́ ñ \x1c\x1d odd", "a<|endoftext|>b", "foo  <|endoftext|> bar",
    "!!!??? ...", " lead", "trail ", " nbsp  x", "\x85next", "emoji 😀😀 ok", "word " * 5000,
]


def test_parts_encode_as_the_whole_text():
    enc = Encoder(P.path("byte_bpe_50k.json"), 2)
    assert enc.by_part and enc.kind.itemsize == 2
    rng = np.random.default_rng(5)
    alphabet = list("ab 'st\n\t\r  \x1c1!é日") + ["<|endoftext|>", "  "]
    texts = TEXTS + ["".join(rng.choice(alphabet, 30)) for _ in range(800)]
    plain = [t for t in texts if not enc.odd.search(t)]
    for some in (texts, plain, plain, [""], ["", "a", ""]):
        ids, counts = enc.encode(pa.array(some))
        at = np.cumsum(counts)
        for text, got in zip(some, np.split(ids, at[:-1]), strict=True):
            assert got.tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_round_trip_order_and_nulls(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(reversed(TEXTS))] + [(3, "again", "x"), (100, None, None), (None, "no id", "x"), (-7, "minus", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = write_tokens(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 2)
    got = sorted(read_digests(spark, str(tmp_path / "t"), manifest).collect(), key=lambda r: r.start)
    enc = Encoder(P.path("byte_bpe_50k.json"), 2)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc_id, text, _) in zip(got, want, strict=True):
        ids = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert manifest["n_tokens"] == at
    first = manifest["shards"][0]
    assert len(Shard(str(tmp_path / "t"), first["name"], manifest["dtype"])) == first["n_docs"]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = write_tokens(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), 2)
    assert manifest["shards"] == [] and read_digests(spark, str(tmp_path / "t"), manifest).count() == 0
