"""What a worker has already worked out for parts of texts.

A part is found by a 64-bit hash of its bytes in an open-addressing table, and what is found counts only
if its bytes are the same. Results lie in flat buffers, so a million parts take a few dozen megabytes and
the results of a whole batch are gathered at once. The table is emptied when full: that costs time only.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np

from .words import mix

#: What each operator keeps in this worker, and how to let go of it.
_holders: weakref.WeakKeyDictionary[object, Callable[[], None]] = weakref.WeakKeyDictionary()


def release(keep: object = None) -> None:
    """Let go of what other operators keep: a worker outlives its tasks and serves one operator after another."""
    for holder, clear in list(_holders.items()):
        if holder is not keep:
            clear()


class Known:
    def __init__(self, kinds: tuple[np.dtype | str, ...], limit: int):
        self.kinds, self.limit = [np.dtype("u1"), *(np.dtype(k) for k in kinds)], limit  # first the parts' own bytes
        self.clear()
        own = weakref.ref(self)
        _holders[self] = lambda: (k := own()) and k.size and k.clear()

    def clear(self) -> None:
        self.size = 0
        self._room(1 << 16)
        self.flat = [bytearray() for _ in self.kinds]
        self.ends = [np.zeros(1, np.int64) for _ in self.kinds]

    def _room(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros(slots, np.uint64)
        self.rows = np.zeros(slots, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        keys = np.maximum(keys, np.uint64(1))
        out = np.full(len(keys), -1, np.int64)
        at, slot = np.arange(len(keys)), keys & self.mask
        while len(at):
            there = self.keys[slot]
            hit = there == keys[at]
            out[at[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            at, slot = at[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def _insert(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            own = free & (self.keys[slot] == keys)  # of several for one slot the last has it
            self.rows[slot[own]] = rows[own]
            keys, rows, slot = keys[~own], rows[~own], (slot[~own] + np.uint64(1)) & self.mask

    def add(self, keys: np.ndarray, *columns: list[bytes]) -> None:
        """Results of new, different keys; the first column is the parts' bytes."""
        keys = np.maximum(keys, np.uint64(1))
        rows = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        if 2 * self.size > len(self.keys):
            old_keys, old_rows = self.keys, self.rows
            used = old_keys != 0
            self._room(1 << (4 * self.size - 1).bit_length())
            self._insert(old_keys[used], old_rows[used])
        self._insert(keys, rows)
        for i, column in enumerate(columns):
            self.flat[i] += b"".join(column)
            more = np.cumsum(np.fromiter(map(len, column), np.int64, len(column))) // self.kinds[i].itemsize
            self.ends[i] = np.concatenate([self.ends[i], self.ends[i][-1] + more])

    def rows_of(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, work: Callable[[np.ndarray, list[bytes]], Iterator[tuple]]) -> np.ndarray:
        """The row of each part ``data[begin:end]`` with hash ``keys``.

        ``work`` gets places and bytes of new parts and yields (which of them, columns of results). Parts of
        one hash and different bytes are told apart: all but the first go by a hash of the hash.
        """
        if self.size > self.limit:
            self.clear()
        out, at, keys = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.copy()
        raw = None
        while len(at):
            own = keys[at]
            rows = self.find(own)
            missing = np.flatnonzero(rows < 0)
            if len(missing):
                raw = data.tobytes() if raw is None else raw
                _, one = np.unique(own[missing], return_index=True)
                new = missing[one]
                parts = [raw[a:b] for a, b in zip(begin[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
                for some, *columns in work(at[new], parts):
                    self.add(own[new[some]], [parts[k] for k in some.tolist()], *columns)
                rows[missing] = self.find(own[missing])
            same = self._same(rows, data, begin[at], end[at])
            out[at[same]] = rows[same]
            at = at[~same]
            keys[at] = mix(keys[at] + np.uint64(1))
        return out

    def _same(self, rows: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the parts have the bytes of the rows found for them."""
        ends, size = self.ends[0], end - begin
        same = ends[rows + 1] - ends[rows] == size
        some = np.flatnonzero(same)
        flat, offsets = self.gather(0, rows[some])
        shift = np.repeat(begin[some] - offsets[:-1], size[some])
        shift += np.arange(len(flat))
        differ = np.flatnonzero(flat != data[shift])
        same[some[np.searchsorted(offsets, differ, "right") - 1]] = False
        return same

    def gather(self, column: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The results of ``rows`` one after the other, and where each begins and ends."""
        ends, flat = self.ends[column], np.frombuffer(bytes(0), self.kinds[column])
        if self.flat[column]:
            flat = np.frombuffer(self.flat[column], self.kinds[column])
        lengths = ends[rows + 1] - ends[rows]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        source = np.repeat(ends[rows] - offsets[:-1], lengths)
        source += np.arange(offsets[-1])
        out = flat[source]
        del flat  # else the buffer couldn't grow
        return out, offsets
