"""Boundaries of zstd frames, found from their structure (RFC 8878) without decompressing."""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import zstandard

MAGIC = b"\x28\xb5\x2f\xfd"
#: Fixed values of the format.
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
MOST_BLOCKS = 1_000_000
_SIZE_OF_CONTENT = (0, 2, 4, 8)
_SIZE_OF_DICTIONARY = (0, 1, 2, 4)
_RLE, _RESERVED = 1, 3


class Frame(NamedTuple):
    start: int
    end: int
    content_size: int | None = None
    skippable: bool = False
    blocks: int = 0


class Incomplete(NamedTuple):
    """The bytes end inside the frame; ``need`` more are needed at least."""

    start: int
    need: int


class Corrupt(NamedTuple):
    start: int
    reason: str


def walk(data: bytes | memoryview, at: int = 0) -> Frame | Incomplete | Corrupt | None:
    """The frame that begins at ``at``; None at the end of the data."""
    size = len(data)
    left = size - at
    if left <= 0:
        return None
    if left < 4:
        return Incomplete(at, 4 - left)
    (magic,) = struct.unpack_from("<I", data, at)
    if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
        if left < 8:
            return Incomplete(at, 8 - left)
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        return Frame(at, end, skippable=True) if end <= size else Incomplete(at, end - size)
    if data[at : at + 4] != MAGIC:
        return Corrupt(at, "bad magic")
    if left < 5:
        return Incomplete(at, 5 - left)
    descriptor = data[at + 4]
    if descriptor & 0x08:
        return Corrupt(at, "reserved bit set in frame header descriptor")
    single = bool(descriptor & 0x20)
    content_bytes = _SIZE_OF_CONTENT[descriptor >> 6] or int(single)
    content_at = at + 5 + (not single) + _SIZE_OF_DICTIONARY[descriptor & 3]
    cursor = content_at + content_bytes
    if cursor > size:
        return Incomplete(at, cursor - size)
    content = int.from_bytes(data[content_at:cursor], "little") + 256 * (content_bytes == 2) if content_bytes else None
    blocks = 0
    while True:
        if cursor + 3 > size:
            return Incomplete(at, cursor + 3 - size)
        header = data[cursor] | data[cursor + 1] << 8 | data[cursor + 2] << 16
        kind = header >> 1 & 3
        if kind == _RESERVED:
            return Corrupt(at, "reserved block type")
        cursor += 3 + (1 if kind == _RLE else header >> 3)
        if cursor > size:
            return Incomplete(at, cursor - size)
        blocks += 1
        if header & 1:
            break
        if blocks > MOST_BLOCKS:
            return Corrupt(at, "implausible block count")
    if descriptor & 0x04:
        cursor += 4
        if cursor > size:
            return Incomplete(at, cursor - size)
    return Frame(at, cursor, content, False, blocks)


#: Blocks that a frame may have to be measured together with others; longer ones are walked one by one.
_ROUNDS = 16
_CONTENT, _DICTIONARY = np.array(_SIZE_OF_CONTENT), np.array(_SIZE_OF_DICTIONARY)


class Spans(NamedTuple):
    """Frames from a place on, one after another, and what stands behind them as ``walk`` tells it."""

    starts: np.ndarray
    ends: np.ndarray
    stop: Incomplete | Corrupt | None

    def after(self, at: int) -> int:
        """Where the last frame ends; ``at`` without one."""
        return int(self.ends[-1]) if len(self.ends) else at


def _measure(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """Where frames that begin at ``starts`` end, all at once; -1 where only ``walk`` can tell."""
    view = np.frombuffer(data, np.uint8)
    size, ends = len(view), np.full(len(starts), -1, np.int64)
    # The longest header has 18 bytes, a block's three more.
    which = np.flatnonzero(starts + 21 <= size)
    descriptor = view[starts[which] + 4].astype(np.int64)
    which, descriptor = which[descriptor & 0x08 == 0], descriptor[descriptor & 0x08 == 0]
    single = descriptor >> 5 & 1
    content = np.maximum(_CONTENT[descriptor >> 6], single)
    cursor = starts[which] + 6 - single + _DICTIONARY[descriptor & 3] + content
    for _ in range(_ROUNDS):
        inside = cursor + 3 <= size
        which, descriptor, cursor = which[inside], descriptor[inside], cursor[inside]
        if not len(which):
            break
        header = view[cursor].astype(np.int64) | view[cursor + 1].astype(np.int64) << 8 | view[cursor + 2].astype(np.int64) << 16
        kind = header >> 1 & 3
        cursor = cursor + 3 + np.where(kind == _RLE, 1, header >> 3)
        last = (header & 1 == 1) & (kind != _RESERVED)
        ends[which[last]] = cursor[last] + (descriptor[last] & 0x04)
        more = (header & 1 == 0) & (kind != _RESERVED)
        which, descriptor, cursor = which[more], descriptor[more], cursor[more]
    ends[ends > size] = -1
    return ends


def boundaries(data: bytes | memoryview, at: int = 0) -> Spans:
    """All frames from ``at`` on, the same that repeated calls of ``walk`` find.

    Every place of the magic number is measured as if a frame began there, in arrays. Frames that follow each other are
    then taken in runs; where a run breaks (a skippable frame, many blocks, a magic number inside a frame) ``walk`` goes on.
    """
    raw, places, found = bytes(data) if isinstance(data, memoryview) else data, [], at - 1
    while (found := raw.find(MAGIC, found + 1)) >= 0:
        places.append(found)
    starts = np.array(places, np.int64)
    ends = _measure(raw, starts) if len(starts) else starts
    breaks = np.flatnonzero(np.append(ends[:-1] != starts[1:], True)) if len(starts) else starts
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        i = int(np.searchsorted(starts, at))
        if i < len(starts) and starts[i] == at and ends[i] >= 0:
            last = int(breaks[np.searchsorted(breaks, i)]) + 1
            last -= int(ends[last - 1] < 0)
            parts.append((starts[i:last], ends[i:last]))
            at = int(ends[last - 1])
            continue
        one = walk(raw, at)
        if not isinstance(one, Frame):
            none = np.zeros(0, np.int64)
            return Spans(*(np.concatenate([none, *(p[k] for p in parts)]) for k in (0, 1)), one)
        parts.append((np.array([one.start]), np.array([one.end])))
        at = one.end


@lru_cache(1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def next_magic(data: bytes, start: int = 0) -> int:
    """Where the next frame may begin, -1 if nowhere."""
    return data.find(MAGIC, start)


def decode(data: bytes | memoryview, frame: Frame) -> str:
    """The frame's text; a skippable frame has none, bytes that aren't UTF-8 become U+FFFD."""
    return text_at(data, frame.start, frame.end)


def text_at(data: bytes | memoryview, start: int, end: int) -> str:
    """The text of the frame from ``start`` to ``end``."""
    one = bytes(data[start:end])
    if not one.startswith(MAGIC):
        return ""
    stream = _decompressor().decompressobj()
    text = stream.decompress(one)
    if not stream.eof:
        raise zstandard.ZstdError("the frame's data end early")
    return text.decode("utf-8", "replace")
