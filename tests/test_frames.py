import os
import random
import struct

import pytest
import zstandard

from auditloom.sources.frames import MAGIC, Corrupt, Frame, Incomplete, boundaries, decode, next_magic, walk
from auditloom.testing import frame, skippable


def test_single_frame_span_and_text():
    data = frame({"type": "a", "seq": 1})
    found = walk(data)
    assert isinstance(found, Frame) and (found.start, found.end) == (0, len(data)) and not found.skippable
    assert decode(data, found) == '{"type":"a","seq":1}\n'
    assert walk(data, len(data)) is None


@pytest.mark.parametrize("cut", [1, 4, 5, 8, -1])
def test_cut_frames_are_incomplete(cut):
    data = frame({"type": "a", "text": "x" * 100})
    found = walk(data[:cut])
    assert isinstance(found, Incomplete) and found.need > 0


def test_corrupt():
    assert walk(b"plain text, no frame").reason == "bad magic"
    data = bytearray(frame({"a": 1}))
    data[4] |= 0x08
    assert isinstance(walk(bytes(data)), Corrupt)


def test_skippable_frames_and_their_cut_headers():
    data = skippable(b"hidden") + frame({"a": 1})
    found = walk(data)
    assert found.skippable and found.end == 14 and decode(data, found) == ""
    for n in (4, 5, 7, 10):
        assert isinstance(walk(data[:n]), Incomplete)


def test_resync():
    assert next_magic(b"junk" + frame({"a": 1})) == 4 and next_magic(b"no frame here") == -1


@pytest.mark.parametrize("options", [{}, {"write_checksum": True}, {"write_content_size": False}, {"level": 19}])
def test_headers_of_all_kinds(options):
    for size in (0, 1, 200, 300, 70_000, 400_000):
        body = os.urandom(size // 2) + b"a" * (size - size // 2)
        data = zstandard.ZstdCompressor(**options).compress(body)
        found = walk(data + MAGIC)
        assert (found.start, found.end) == (0, len(data))
        if options.get("write_content_size", True):
            assert found.content_size == size
    streamed = zstandard.ZstdCompressor().compressobj()
    data = streamed.compress(b"ab" * 300_000) + streamed.flush()
    assert walk(data).end == len(data) and walk(data).blocks > 1


def test_bad_utf8_is_replaced_and_bad_payload_raises():
    data = zstandard.ZstdCompressor().compress(b"\xff\xfe ok")
    assert decode(data, walk(data)) == "�� ok"
    broken = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(b"hello" * 50))
    broken[-1] ^= 1
    with pytest.raises(zstandard.ZstdError):
        decode(bytes(broken), walk(bytes(broken)))


def one_by_one(data, at=0):
    spans = []
    while isinstance(found := walk(data, at), Frame):
        spans.append((found.start, found.end))
        at = found.end
    return spans, found


def test_boundaries_equal_repeated_walks():
    """Also over skippable frames, frames of many blocks, magic numbers inside frames, cuts and flipped bytes."""
    rng = random.Random(4)
    # Raw blocks, so that the magic number stands in the frame as it is.
    raw = MAGIC + bytes([0]) + bytes([0x50]) + b"".join(struct.pack("<I", len(b) << 3 | last)[:3] + b for b, last in ((MAGIC * 40, 0), (b"x" + MAGIC, 0), (MAGIC, 1)))
    blocks = MAGIC + bytes([0, 0x50]) + b"".join(struct.pack("<I", 1 << 3 | (i == 39))[:3] + b"a" for i in range(40))
    kinds = [lambda: frame({"i": rng.random()}), lambda: skippable(MAGIC * rng.randint(0, 3)), lambda: raw, lambda: blocks, lambda: frame({"t": os.urandom(rng.randint(0, 300_000)).hex()}), lambda: zstandard.ZstdCompressor(write_checksum=True, write_content_size=False).compress(b"{}\n" * 99)]
    for n in range(120):
        data = b"".join(rng.choice(kinds[:4] + kinds[5:] if n % 10 else kinds)() for _ in range(rng.randint(0, 60)))
        if n % 3 == 1:
            data = data[: rng.randint(0, len(data))]
        elif n % 3 == 2 and data:
            at = rng.randrange(len(data))
            data = data[:at] + bytes([rng.randrange(256)]) + data[at + 1 :]
        spans = boundaries(data)
        assert (list(zip(spans.starts.tolist(), spans.ends.tolist())), spans.stop) == one_by_one(data)
        if len(spans.starts) > 3:
            part = boundaries(memoryview(data), int(spans.starts[2]))
            assert part.starts.tolist() == spans.starts[2:].tolist() and part.after(0) == spans.after(0)
