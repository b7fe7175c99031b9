"""Token ids of documents as flat binary files (operator 1).

A data set is a folder of shards in ascending doc_id order and a manifest. Shard k is

* ``<name>.bin`` - the ids, little-endian unsigned 16-bit where the vocabulary allows, else 32-bit;
* ``<name>.idx`` - little-endian 64-bit: the number of documents n, n + 1 offsets into the shard's
  ids, n doc_ids, and n flags that are 1 where the doc_id is null.

``manifest.json`` lists the shards with the position of each one's first id in the whole sequence, a
prefix sum of the shards' lengths, so any document is found by one addition and both files can be
memory-mapped.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import mapped, writing
from .known import Known, release
from .sizes import shuffle_partitions
from .words import buffers, byte_hashes, pieces

#: White space in ASCII, and the UTF-8 of any other character that the tokenizer's pattern takes for it.
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[*range(0x09, 0x0E), 0x20]] = True
_OTHER_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Known parts per worker.
CACHE = 1_500_000


def parts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin that encode alone as they do in the text.

    The tokenizer's pattern never joins a word to what stands before its one leading space, and of a
    run of white space before a word it leaves the last character to itself or to the word. So parts
    begin at each text, at each end of a word, at the last white space before a word, and at a word
    that has no space before it.
    """
    white = _ASCII_WHITE[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    begin[1:-1] |= white[1:] != white[:-1]
    word = np.flatnonzero(begin[:-1] & ~white)
    word = word[(word > 0)]
    word = word[white[word - 1] & ~np.isin(word, offsets)]
    begin[word - 1] = True
    begin[word[data[word - 1] == 0x20]] = False
    return np.flatnonzero(begin[:-1])


class Encoder:
    """Ids of texts by the tokenizers library, each distinct part of a text encoded once."""

    def __init__(self, tokenizer_file: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        highest = max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.kind = np.dtype("<u2" if highest < 1 << 16 else "<u4")
        self.end_id = end_id
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What makes a text go through the library as a whole.
        self.odd = re.compile("|".join([_OTHER_WHITE.pattern, *added]))
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        self.by_part = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        self.known = Known((self.kind,), CACHE)
        self.lengths = np.zeros(highest + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token)  # the byte-level alphabet has one character for each byte

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _work(self, places: np.ndarray, new: list[bytes]) -> Iterator[tuple]:
        """Encode new parts. Those of a space and a word keep their ids when run together, and the
        lengths of their tokens say where each ends; one call for many of them is much the fastest."""
        led = np.array([len(p) > 1 and p[0] == 0x20 and not _ASCII_WHITE[p[1]] for p in new], bool)
        alone = [p.decode() for p, x in zip(new, led.tolist(), strict=True) if not x]
        yield np.flatnonzero(~led), self._pack(alone)
        run = [p for p, x in zip(new, led.tolist(), strict=True) if x]
        packed: list[bytes] = []
        for at in range(0, len(run), 20_000):
            some = run[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids, np.int64)
            cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in some])) + 1) * self.kind.itemsize
            flat = ids.astype(self.kind).tobytes()
            packed += [flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]
        yield np.flatnonzero(led), packed

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, each text's followed by the end id; their numbers."""
        everything, offsets = buffers(column)
        data, offsets = everything[offsets[0] : offsets[-1]], offsets - offsets[0]
        texts = column.to_pylist()
        whole = [k for k, t in enumerate(texts) if t and (not self.by_part or self.odd.search(t))]
        release(self.known)
        begin = parts(data, offsets)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        if whole:
            skip = np.zeros(len(texts), bool)
            skip[whole] = True
            text = np.searchsorted(offsets, begin, "right") - 1
            begin, end = begin[~skip[text]], end[~skip[text]]
        rows = self.known.rows_of(byte_hashes(data, begin, end), data, begin, end, self._work)
        ids, ends = self.known.gather(1, rows)
        upto = ends[np.searchsorted(begin, offsets)]
        if not whole:
            return np.insert(ids, upto[1:], self.kind.type(self.end_id)), np.diff(upto) + 1
        lists = [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        for k, own in zip(whole, self._pack([texts[k] for k in whole]), strict=True):
            lists[k] = np.frombuffer(own, self.kind)
        tail = np.array([self.end_id], self.kind)
        return np.concatenate([x for own in lists for x in (own, tail)]), np.array([len(x) + 1 for x in lists], np.int64)


@lru_cache(4)
def encoder(tokenizer_file: str, end_id: int) -> Encoder:
    return Encoder(tokenizer_file, end_id)


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, tokenizer_file: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, name = encoder(tokenizer_file, end_id), uuid.uuid4().hex
    ids: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    null: list[np.ndarray] = []
    with writing(f"{folder}/{name}.bin") as out:
        for batch in batches:
            doc, text = batch.column(0), batch.column(1).fill_null("")
            ids.append(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            null.append(doc.is_null().to_numpy(zero_copy_only=False).astype("<i8"))
            for rows in pieces(buffers(text)[1]):
                own, counts = enc.encode(text.slice(rows.start, rows.stop - rows.start))
                lengths.append(counts)
                out.write(own.tobytes())
    if not lengths:
        return
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
    with writing(f"{folder}/{name}.idx") as out:
        out.write(np.array([len(offsets) - 1], "<i8").tobytes())
        out.write(offsets.tobytes())
        out.write(np.concatenate(ids).tobytes())
        out.write(np.concatenate(null).tobytes())
    yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int) -> dict[str, Any]:
    """Encode every whole text of ``docs`` (doc_id, text) into ``folder``; returns the manifest.

    A null or empty text has the end id alone. Rows with a null doc_id come first; rows of one doc_id
    follow in order of their texts. A lost executor's shard is written again under another name, and
    only names that reached the driver enter the manifest. The driver holds one row for each shard.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange(shuffle_partitions(own), "doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(lambda it: _write_shard(it, folder, tokenizer_file, end_id), "shard int, name string, n_docs long, n_tokens long").collect()
    shards.sort(key=lambda r: r.shard)
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in shards], dtype=np.int64)]) if shards else [0]
    manifest = {
        "version": 1,
        "dtype": encoder(tokenizer_file, end_id).kind.str,
        "end_id": end_id,
        "n_tokens": int(bases[-1]),
        "shards": [{"name": r.name, "base": int(base), "n_docs": r.n_docs, "n_tokens": r.n_tokens} for r, base in zip(shards, bases, strict=False)],
    }
    with writing(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard's documents, memory-mapped."""

    def __init__(self, folder: str, name: str, dtype: str):
        index = mapped(f"{folder}/{name}.idx").view("<i8")
        n = int(index[0])
        self.offsets, self.doc_ids, self.null = index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 : 3 * n + 2]
        self.ids = mapped(f"{folder}/{name}.bin").view(dtype)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.ids[self.offsets[k] : self.offsets[k + 1]]


def _digests(batches: Iterator[pa.RecordBatch], folder: str, dtype: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(folder, row["name"], dtype)
            for at in range(0, len(shard), 10_000):
                some = range(at, min(at + 10_000, len(shard)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.doc_ids[some.start : some.stop], pa.int64(), mask=shard.null[some.start : some.stop] == 1),
                    "start": shard.offsets[some.start : some.stop] + row["base"],
                    "n_tokens": np.diff(shard.offsets[some.start : some.stop + 1]),
                    "ids_crc32": pa.array([zlib.crc32(shard[k].astype("<u4").tobytes()) for k in some], pa.int64()),
                })


def read_digests(spark: SparkSession, folder: str, manifest: dict[str, Any]) -> DataFrame:
    """Per document of a written data set: doc_id, start, n_tokens, ids_crc32; one task for each shard."""
    shards = [(s["name"], s["base"]) for s in manifest["shards"]]
    frame = spark.createDataFrame(shards, "name string, base long").repartition(max(1, len(shards)))
    return frame.mapInArrow(lambda it: _digests(it, folder, manifest["dtype"]), "doc_id long, start long, n_tokens long, ids_crc32 long")
