"""Benchmark decontamination (operator 3), by suffix arrays of the training texts.

Each shard of the documents, a run of whole texts that a task holds at one time, gets a suffix array:
the places where a benchmark passage could begin, sorted by the words that follow. Every suffix of every
benchmark item is then found by binary search, extended word by word to its longest verbatim match,
and its places are read off the array. Only places inside a run of words that the benchmark knows, long
enough to hold a window, enter the array; no other suffix could match.

The benchmark is a query set: it is read in blocks of bounded size, and each block is sent to all tasks.
With one block the documents aren't shuffled at all; with several, the hits of a document are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import sheltered
from .known import release
from .words import ALNUM, LOWER, Chunk, chunks

WINDOW, ITEMS = 8, 2
#: Benchmark texts of a block have about as many characters; an item that is longer is a block of its own.
BLOCK_SIZE = 4 << 20
_SHARD = 1 << 20


class Block(NamedTuple):
    """A block of the benchmark: its words' hashes in order (word i + 1 is ``vocabulary[i]``), the items'
    words one after the other, each followed by a 0, the item of each word, and the windows to look for."""

    vocabulary: np.ndarray
    words: np.ndarray
    items: list[int | None]
    keys: np.ndarray  # low and high key of each window's words
    length: np.ndarray  # words of each window
    places: np.ndarray  # where in ``words`` its occurrences begin, by window and then by all words up to the item's end
    from_place: np.ndarray  # where each window's places begin
    item_of: np.ndarray  # item of each word
    of_window: np.ndarray  # item of each (window, item), sorted by window
    first: np.ndarray  # where each window's items begin
    least: int  # words of the shortest window


def _keys(words: np.ndarray, at: np.ndarray, length: np.ndarray | int, width: int, high: bool = False) -> np.ndarray:
    """The next ``width`` words from each place as bytes that sort like them; those past ``length`` are least or highest."""
    padded = np.concatenate([words, np.zeros(width, words.dtype)])
    out = np.empty((len(at), width), words.dtype.newbyteorder(">"))
    for j in range(width):
        out[:, j] = np.where(j < length, padded[at + j], np.iinfo(words.dtype).max if high else 0)
    return out.view(f"S{words.itemsize * width}").ravel()


def _ranks(words: np.ndarray, longest: int) -> np.ndarray:
    """Ranks that sort the suffixes of ``words`` by their words up to a 0, by doubling; a 0 is least."""
    rank, k = words.astype(np.int64), 1
    while k < longest + 1:
        then = np.zeros(len(rank), np.int64)
        then[:-k] = rank[k:]
        _, rank = np.unique(rank * (int(rank.max()) + 1) + np.where(words > 0, then, 0), return_inverse=True)
        k *= 2
    return rank


def _pack(hashes: np.ndarray, first: np.ndarray, items: list[int | None], width: int) -> Block:
    vocabulary = np.unique(hashes)
    ids = (np.searchsorted(vocabulary, hashes) + 1).astype(np.uint16 if len(vocabulary) < 0xFFFF else np.uint32)
    counts = np.diff(first)
    words = np.zeros(len(ids) + len(items), ids.dtype)
    item_of = np.repeat(np.arange(len(items)), counts)
    at = np.arange(len(ids)) + item_of
    words[at] = ids
    end = np.repeat(first[1:], counts) + item_of
    size = np.minimum(np.repeat(counts, counts), width)
    begins = (at + size <= end) & ((size == width) | (at == np.repeat(first[:-1] + np.arange(len(items)), counts)))
    at, size, item_of = at[begins], size[begins].astype(np.int64), item_of[begins]
    # A window is its words: shorter ones end in zeros, which no word is.
    _, one, window = np.unique(_keys(words, at, size, width), return_index=True, return_inverse=True)
    order = np.lexsort((at, _ranks(words, int(counts.max(initial=0)))[at], window)) if len(one) < len(at) else one
    pairs = np.unique(np.stack([window, item_of], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    low = _keys(words, at[one], size[one], width)
    high = _keys(words, at[one], size[one], width, high=True)
    return Block(vocabulary, words, items, np.stack([low, high]), size[one], at[order], np.searchsorted(window[order], np.arange(len(one) + 1)), np.repeat(np.arange(len(items)), counts + 1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), int(size.min(initial=width)))


def benchmark_blocks(items: DataFrame, width: int = WINDOW, block_size: int = BLOCK_SIZE) -> Iterator[Block]:
    """Blocks of a benchmark (item_id, text), read one partition at a time."""
    ids: list[int | None] = []
    texts: list[str] = []

    def block() -> Block:
        (c,) = chunks(pa.array(texts, pa.string()), ALNUM, LOWER, limit=1 << 62)
        return _pack(c.hashes(), c.first, list(ids), width)

    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        if row.text:
            ids.append(row.item_id)
            texts.append(row.text)
            size += len(row.text)
            if size >= block_size:
                yield block()
                ids, texts, size = [], [], 0
    if texts:
        yield block()


class SuffixArray:
    """The suffixes of a chunk of texts that can hold a window of a block, sorted by their first words."""

    def __init__(self, chunk: Chunk, block: Block, width: int):
        hashes = chunk.hashes()
        found = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        known = block.vocabulary[found] == hashes
        # A 0 ends each text, as it stands for each word that the benchmark hasn't.
        text = chunk.texts()
        self.place = np.arange(len(hashes)) + text
        self.words = np.zeros(len(hashes) + len(chunk.first), block.words.dtype)
        self.words[self.place] = np.where(known, found + 1, 0)
        self.text_of = np.searchsorted(chunk.first + np.arange(len(chunk.first)), np.arange(len(self.words)), "right") - 1
        is_known = self.words > 0
        stop = np.flatnonzero(~is_known)
        run = stop[np.searchsorted(stop, np.arange(len(self.words)))] - np.arange(len(self.words)) if len(self.words) else stop
        self.suffixes = np.flatnonzero(run >= block.least)
        keys = _keys(self.words, self.suffixes, width, width)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = self.suffixes[order], keys[order]

    def search(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the part of the array between its keys, by binary search."""
        return np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")

    def extend(self, at: np.ndarray, other: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many words the matches at ``at`` and ``place`` of ``other`` have in common, beyond ``length``."""
        length = length.copy()
        going = np.arange(len(at))
        while len(going):
            a, b = at[going] + length[going], place[going] + length[going]
            same = (self.words[np.minimum(a, len(self.words) - 1)] == other[np.minimum(b, len(other) - 1)]) & (other[np.minimum(b, len(other) - 1)] > 0) & (a < len(self.words)) & (b < len(other))
            going = going[same]
            length[going] += 1
        return length

    def longest(self, at: np.ndarray, window: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The longest match of each place with any occurrence of its window, and where that occurrence begins.

        Binary search among the window's sorted occurrences; both neighbours of the place's suffix are met.
        """
        low, high = block.from_place[window].copy(), block.from_place[window + 1].copy()
        best, where = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        going = np.arange(len(at))
        while len(going):
            middle = (low[going] + high[going]) // 2
            place = block.places[middle]
            length = self.extend(at[going], block.words, place, block.length[window[going]])
            more = length > best[going]
            best[going[more]], where[going[more]] = length[more], place[more]
            own = np.minimum(at[going] + length, len(self.words) - 1)
            right = block.words[np.minimum(place + length, len(block.words) - 1)] <= self.words[own]
            low[going[right]], high[going[~right]] = middle[right] + 1, middle[~right]
            going = going[low[going] < high[going]]
        return best, where


def matches(chunk: Chunk, block: Block, width: int) -> tuple[np.ndarray, np.ndarray, SuffixArray]:
    """All places of all windows: the place in the array's words, and the window."""
    array = SuffixArray(chunk, block, width)
    low, high = array.search(block.keys[0], block.keys[1])
    n = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(n)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return array.suffixes[rank], window, array


def _hits(batches: Iterator[pa.RecordBatch], block: Block | None, width: int, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Per text: n_words, the covered stretches, the items, and the longest match with its places."""
    release()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for c in chunks(column, ALNUM, LOWER, limit=_SHARD):
            n = c.rows.stop - c.rows.start
            nothing = block is None or not len(block.vocabulary) or not len(c.start)
            at, window, array = (np.zeros(0, np.int64),) * 2 + (None,) if nothing else matches(c, block, width)
            stretches: list[list[dict[str, int]]] = [[] for _ in range(n)]
            items: list[list[int | None]] = [[] for _ in range(n)]
            longest: list[dict | None] = [None] * n
            if len(at):
                cover = np.zeros(len(array.words) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + block.length[window], 1)
                edge = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]]))
                base = c.first + np.arange(len(c.first))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    text = int(array.text_of[a])
                    stretches[text].append({"first": a - int(base[text]), "stop": b - int(base[text])})
                text = array.text_of[at]
                per = block.first[window + 1] - block.first[window]
                item = block.of_window[np.repeat(block.first[window] - np.cumsum(per) + per, per) + np.arange(per.sum())]
                for t, i in np.unique(np.stack([np.repeat(text, per), item], 1), axis=0).tolist():
                    items[t].append(block.items[i])
                length, place = array.longest(at, window, block)
                order = np.lexsort((at, -length, text))
                _, best = np.unique(text[order], return_index=True)
                for k in order[best].tolist():
                    t = int(text[k])
                    longest[t] = {"length": int(length[k]), "word": int(at[k] - base[t]), "item": block.items[int(block.item_of[place[k]])]}
            yield pa.RecordBatch.from_arrays(
                [*(x.slice(c.rows.start, n) for x in batch.columns), pa.array(c.counts), pa.array(stretches, _STRETCHES), pa.array(items, pa.list_(item_type)), pa.array(longest, pa.struct([("length", pa.int32()), ("word", pa.int32()), ("item", item_type)]))],
                names=[*batch.schema.names, *_ADDED],
            )


_STRETCHES = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
_ADDED = ["_n_words", "_stretches", "_items", "_longest"]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_size: int = BLOCK_SIZE) -> DataFrame:
    """``docs`` with _n_words, _stretches (covered words), _items (items found) and _longest (a longest match).

    A null or empty text has no words and no hits; an item without words finds nothing. Duplicate items
    are found one by one; items with the same or no item_id count once.
    """
    item_kind = dict(benchmark.dtypes)["item_id"]
    item_type = {"int": pa.int32(), "bigint": pa.int64()}.get(item_kind, pa.string())
    items = benchmark if item_kind in ("int", "bigint") else benchmark.withColumn("item_id", F.col("item_id").cast("string"))
    item_sql = item_kind if item_kind in ("int", "bigint") else "string"
    added = f"_n_words long, _stretches array<struct<first:int,stop:int>>, _items array<{item_sql}>, _longest struct<length:int,word:int,item:{item_sql}>"
    own = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", " + added

    def one(frame: DataFrame, block: Block | None) -> DataFrame:
        return frame.mapInArrow(lambda it: _hits(it, block, width, item_type), schema)

    out, k = None, 0
    for block in benchmark_blocks(items, width, block_size):
        if out is None:
            out = one(own, block)
            continue
        # Another block: the texts run through it too, and its hits join those so far, row by row.
        k += 1
        renamed = out.select(*docs.columns, *[F.col(c).alias(f"{c}{k}") for c in _ADDED])
        flat = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema) + ", " + added
        more = renamed.mapInArrow(lambda it, b=block: _hits(it, b, width, item_type), flat)
        longest = F.when(F.coalesce(F.col("_longest.length"), F.lit(0)) > F.coalesce(F.col(f"_longest{k}.length"), F.lit(0)), F.col("_longest")).otherwise(F.col(f"_longest{k}"))
        out = more.select(*docs.columns, "_n_words", F.concat("_stretches", f"_stretches{k}").alias("_stretches"), F.concat("_items", f"_items{k}").alias("_items"), longest.alias("_longest"))
    return out if out is not None else one(own, None)


def _merged(first: str) -> str:
    """SQL: how many words the stretches of a text cover together."""
    return f"""aggregate(array_sort({first}), named_struct('n', 0L, 'stop', 0),
        (a, s) -> named_struct('n', a.n + greatest(0, s.stop - greatest(s.first, a.stop)), 'stop', greatest(a.stop, s.stop)), a -> a.n)"""


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = ITEMS, width: int = WINDOW, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest match."""
    found = find_benchmark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, width, block_size).drop("text")
    names = F.array_sort(F.array_distinct(F.transform("_items", lambda x: F.coalesce(x.cast("string"), F.lit("")))))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.expr(_merged("_stretches")).alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size(names) >= least_items).alias("contaminated"), F.col("_longest").alias("longest_match"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_items: int = ITEMS, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold passages of the benchmark.

    A row goes if it has ``width`` consecutive words of any one item, or windows of ``least_items`` items: items
    of fewer words than ``width`` are windows as a whole, and one of them alone may be chance. Null and empty
    texts stay, as does every row where the benchmark is empty.
    """
    own, restored = sheltered(docs, "text")
    found = find_benchmark(own, benchmark, width)
    clean = (F.coalesce(F.col("_longest.length"), F.lit(0)) < width) & (F.size(F.array_distinct("_items")) < least_items)
    return restored(found.filter(clean))
