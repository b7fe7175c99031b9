"""Words of many texts at once, as arrays.

Every word rule of these operators is about ASCII bytes only, so a text's UTF-8 bytes decide: a batch
of texts becomes one byte array, words become start and end offsets in it, and hashes of words and of
runs of words are worked out side by side, without a Python object for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text: digits, a-z and all non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes as they are, and with A-Z lower-cased.
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 0x20

#: Seeds of two independent hashes; both together make 128 bits where 64 aren't enough.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CHUNK = 1 << 19
#: Bytes of a word that are hashed side by side with other words'; longer ones go through a library hash.
_LANED = 64
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _both(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """A hash of two hashes, in order. Every step is mixed, so no sum or power of a long run is left to cancel out."""
    return mix(a * np.uint64(base) + b * np.uint64(0xA0761D6478BD642F) + np.uint64(base >> 7))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = FIRST) -> np.ndarray:
    """A hash of the bytes ``data[start:end]`` for each pair: eight bytes after another, long ones by BLAKE2."""
    n = end - start
    out = mix(n.astype(np.uint64) + np.uint64(base))
    lanes = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    long = np.flatnonzero(n > _LANED)
    going = np.flatnonzero((n > 0) & (n <= _LANED))
    at, left = start[going], n[going]
    while len(going):
        out[going] = _both(out[going], lanes[at] & _LANE[np.minimum(left, 8)], base)
        on = left > 8
        going, at, left = going[on], at[on] + 8, left[on] - 8
    if len(long):
        salt = base.to_bytes(8, "little")
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [int.from_bytes(hashlib.blake2b(view[a:b], digest_size=8, salt=salt).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def run_hashes(values: np.ndarray, n: int, base: int = FIRST) -> np.ndarray:
    """A hash of each ``values[i:i + n]``, n fixed: runs of 1, 2, 4 ... are put together."""
    size, have, out = len(values) - n + 1, 0, None
    if size <= 0:
        return np.zeros(0, np.uint64)
    level, length = values, 1
    while True:
        if n & length:
            part = level[have : have + size]
            out, have = part if out is None else _both(out, part, base), have + length
        if 2 * length > n:
            return out
        level, length = _both(level[:-length], level[length:], base), 2 * length


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = FIRST) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair, the same wherever the span stands."""
    n, at = end - start, start.copy()
    out = mix(n.astype(np.uint64) + np.uint64(base))
    level, length, longest = values, 1, int(n.max(initial=0))
    while length <= longest:
        some = np.flatnonzero(n & length)
        out[some] = _both(out[some], level[at[some]], base)
        at[some] += length
        if 2 * length <= longest:
            level = _both(level[:-length], level[length:], base)
        length *= 2
    return out


def gram_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = FIRST) -> np.ndarray:
    """Hashes of short spans from one running sum modulo 2**64: for features of a model, never to tell texts apart."""
    up, down = powers(base | 1, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i < n."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, _CHUNK + 1)

        def row(x: int) -> np.ndarray:
            out = np.full(size, x, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        known = (row(base), row(pow(base, -1, 1 << 64)))
        if size <= 2 * _CHUNK + 1:  # tables for one huge text aren't worth keeping
            _powers[base] = known
    return known


class Chunk(NamedTuple):
    """Texts ``rows`` of a batch: word i is ``data[start[i]:end[i]]``; text d has words first[d] to first[d + 1]."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, base: int = FIRST) -> np.ndarray:
        """A 64-bit hash of each word."""
        return byte_hashes(self.folded, self.start, self.end, base)

    def last(self) -> np.ndarray:
        """For each word, the end of its text's words."""
        return np.repeat(self.first[1:], self.counts)

    def texts(self) -> np.ndarray:
        """For each word, its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = _CHUNK) -> Iterator[slice]:
    """Runs of rows with about ``limit`` bytes each; a longer text stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield slice(at, to)
        at = to


def chunks(column: pa.Array, wordy: np.ndarray, fold: np.ndarray, limit: int = _CHUNK) -> Iterator[Chunk]:
    """The words of every whole text of ``column``, about ``limit`` bytes at a time."""
    everything, offsets = buffers(column)
    for rows in pieces(offsets, limit):
        own = offsets[rows.start : rows.stop + 1]
        data = everything[own[0] : own[-1]]
        own = own - own[0]
        is_word = wordy[data]
        edges = own[1:-1]
        before = np.zeros(len(data), bool)
        before[1:] = is_word[:-1]
        before[edges[edges < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = is_word[1:]
        after[edges[edges > 0] - 1] = False
        start = np.flatnonzero(is_word & ~before)
        end = np.flatnonzero(is_word & ~after) + 1
        yield Chunk(rows, data, own, start, end, np.searchsorted(start, own), fold[data])


def runs(chunk: Chunk, hashes: np.ndarray, n: int, base: int = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of n words that lie in one text, and a hash of each."""
    every = run_hashes(hashes, n, base)
    at = np.flatnonzero(np.arange(n, n + len(every)) <= chunk.last()[: len(every)])
    return at, every[at]


def joined(chunk: Chunk, keep: np.ndarray | None = None, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words, or those kept, one space between: the bytes of all texts, and their offsets."""
    which = np.arange(len(chunk.start)) if keep is None else np.flatnonzero(keep)
    text = np.searchsorted(chunk.first, which, "right") - 1
    inner = np.flatnonzero(text[1:] == text[:-1])
    data = (chunk.folded if fold else chunk.data).copy()
    data[chunk.end[which[inner]]] = 0x20
    cover = np.zeros(len(data) + 1, np.int8)
    cover[chunk.start[which]] = 1
    stop = chunk.end[which]
    stop[inner] += 1  # the byte behind a word that isn't its text's last is a separator
    # Neighbours may touch: one ends where the next begins.
    np.subtract.at(cover, stop, 1)
    inside = np.cumsum(cover[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[chunk.offsets]
    return data[inside], offsets


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow string column over bytes and offsets."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the long integers that Spark has."""
    return np.ascontiguousarray(x).view(np.int64)
