"""Byte-pair encoding and decoding (operator 10).

A word's symbols form a doubly linked list and all its mergeable neighbours a priority queue by merge
rank, then place. The best pair is merged, its right symbol unlinked, and the pairs that the new
symbol makes join the queue; an entry whose symbols have changed since is stale and skipped. That is
O(n log n) for a word of n symbols, however long. Decoding looks each id's string up and joins them.

The vocabulary, merges, normalizer and word pattern come from a tokenizer file at run time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .known import Known, release
from .words import AS_IS, SPACED, buffers, chunks, pieces

#: Unicode white space inside a character class.
WHITE = r"\t-\r \x85\xa0  -     　"
_SPAN = re.compile(f"[^{WHITE}]+")
#: Known words, and known parts between white space, per worker.
CACHE, SPANS = 200_000, 800_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    visible = set(shown)
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Bpe:
    """The encoder of one tokenizer file: words end in a suffix, white space is dropped, case is folded."""

    def __init__(self, tokenizer_file: str):
        import regex

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{tokenizer_file} is not a BPE of case-folded words")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.alphabet = byte_alphabet()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings.update({i: s for s, i in added.items()})
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda x: [x]
        self.known_words: dict[str, list[int]] = {}
        self.known = Known(("u1", "u1", "<u4"), SPANS)

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one word, from the ids of its characters."""
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            found = ranks.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, merged = heapq.heappop(queue)
            j = after[i]
            # Stale: the left symbol is gone (-1) or one of the two has been merged since.
            if symbols[i] < 0 or j < 0 or ranks.get((symbols[i], symbols[j])) != (rank, merged):
                continue
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = ranks.get((merged, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbols[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> list[int]:
        ids = self.known_words.get(word)
        if ids is None:
            letters = [self.alphabet[b] for b in word.encode("utf-8")]
            letters[-1] += self.suffix
            ids = self.merge([self.vocab[x] for x in letters if x in self.vocab])
            if len(self.known_words) >= CACHE:
                self.known_words.clear()
            self.known_words[word] = ids
        return ids

    def encode_span(self, span: str) -> list[int]:
        """Ids of text without white space; nothing reaches across white space."""
        out: list[int] = []
        for part in self.split_added(span):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                # Each character is folded by itself, whatever stands around it.
                folded = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                for word in self.words(folded):
                    out += self.encode_word(word)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for span in _SPAN.findall(text) for i in self.encode_span(span)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one space between; special ones too."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def _work(self, places: np.ndarray, new: list[bytes]) -> Iterator[tuple]:
        found = [self.encode(part.decode()) for part in new]
        decimal = [b"%d " * len(x) % tuple(x) for x in found]
        strings = [b"".join([self.strings[i].encode() + b" " for i in x if i in self.strings]) for x in found]
        yield np.arange(len(new)), decimal, strings, [len(x).to_bytes(4, "little") for x in found]

    def digests(self, column: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Per text: the number of ids, SHA-256 of the decimal ids and of the decoded text."""
        everything, offsets = buffers(column)
        data, offsets = everything[offsets[0] : offsets[-1]], offsets - offsets[0]
        # Parts between ASCII white space; a part with other white space is split further when it is encoded.
        (c,) = chunks(column, SPACED, AS_IS, limit=len(data) + 1)
        release(self.known)
        rows = self.known.rows_of(c.hashes(), c.data, c.start, c.end, self._work)
        counts = np.concatenate([[0], np.cumsum(self.known.gather(3, rows)[0], dtype=np.int64)])[c.first]
        hashes = []
        for column_of in (1, 2):
            flat, ends = self.known.gather(column_of, rows)
            view, upto = memoryview(flat), ends[c.first].tolist()
            hashes.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(upto, upto[1:], strict=False)])
        return np.diff(counts).tolist(), *hashes


@lru_cache(4)
def bpe(tokenizer_file: str) -> Bpe:
    return Bpe(tokenizer_file)


def _each(batches: Iterator[pa.RecordBatch], row, fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(1).fill_null("")
        for rows in pieces(buffers(text)[1]):
            n = rows.stop - rows.start
            results = row(text.slice(rows.start, n))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), *(pa.array(x, f.type) for x, f in zip(results, list(fields)[1:], strict=True))], schema=fields)


def bpe_digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty and has no ids; repeated rows and null doc_ids stay as they are.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda it: _each(it, bpe(tokenizer_file).digests, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_tokens(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Per row of ``docs``: doc_id, the ids and the text they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def both(texts: pa.Array) -> tuple[list[list[int]], list[str]]:
        own = bpe(tokenizer_file)
        ids = [own.encode(t) for t in texts.to_pylist()]
        return ids, [own.decode(x) for x in ids]

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lambda it: _each(it, both, schema), "doc_id long, ids array<int>, decoded string")
