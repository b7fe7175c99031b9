"""Records out of a growing byte sequence of zstd frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import IO, Any

import zstandard

from auditloom.functions.jsonish import parse
from auditloom.schemas import TRIMMED
from auditloom.sources.frames import MAGIC, Corrupt, Frame, Incomplete, boundaries, decode, next_magic, text_at, walk
from auditloom.sources.store import open_file, size_of

CHUNK_BYTES, READ_AHEAD, MOST_FRAME_BYTES = 1 << 20, 4, 64 << 20


def leaf(data: bytes) -> bytes:
    """The hash of a tree's leaf: SHA-256 of a zero byte and the data."""
    return hashlib.sha256(b"\x00" + data).digest()


def is_json(line: str) -> bool:
    try:
        parse(line)
    except ValueError:
        return False
    return True


class Tail:
    """Consumes bytes as they come; yields lines and diagnostics of complete frames only.

    A line may reach over frames. ``checkpoint`` is where a reader that starts anew goes on: behind
    the last complete frame, or before the frame in which an unfinished line begins.
    """

    def __init__(self, offset: int = 0, frame: int = 0, most_frame_bytes: int = MOST_FRAME_BYTES):
        self.offset, self.frame, self.most = offset, frame, most_frame_bytes
        self.held = b""
        self.partial, self.records, self.received = "", 0, 0
        self.checkpoint = (offset, frame)
        self.diagnostics = 0

    @property
    def pending(self) -> int:
        """Bytes that are held back."""
        return len(self.held) + len(self.partial.encode("utf-8", "surrogatepass"))

    def feed(self, data: bytes) -> Iterator[dict[str, Any]]:
        self.received += len(data)
        self.held = self.held + data if self.held else data
        at = 0
        view = self.held
        while True:
            found = walk(view, at)
            if isinstance(found, Frame):
                yield from self._frame(view, found, self.offset + at)
                at = found.end
            elif isinstance(found, Corrupt):
                skipped = self._skip(view, at)
                if not skipped:
                    break
                yield self._problem("corrupt", self.offset + at, found.reason, skipped)
                at += skipped
                self.checkpoint = max(self.checkpoint, (self.offset + at, self.frame))
            elif isinstance(found, Incomplete) and len(view) - at > self.most:
                skipped = self._skip(view, at)
                yield self._problem("oversize-frame", self.offset + at, f"frame exceeds {self.most} bytes", skipped)
                at += skipped
                self.checkpoint = max(self.checkpoint, (self.offset + at, self.frame))
            else:
                break
        self.held = view[at:]
        self.offset += at

    @staticmethod
    def _skip(view: bytes, at: int) -> int:
        """Bytes up to the next frame; what may be the beginning of its magic number is kept."""
        found = next_magic(view, at + 1)
        if found >= 0:
            return found - at
        for n in (3, 2, 1):
            if len(view) - at > n and view.endswith(MAGIC[:n]):
                return len(view) - at - n
        return len(view) - at

    def _problem(self, kind: str, offset: int, detail: str, skipped: int = 0) -> dict[str, Any]:
        self.diagnostics += 1
        return {"row_kind": "diagnostic", "frame_index": self.frame, "frame_start": offset, "kind": kind, "detail": detail, "skipped_bytes": skipped}

    def _frame(self, view: bytes, frame: Frame, start: int) -> Iterator[dict[str, Any]]:
        end = start + frame.end - frame.start
        try:
            text = decode(view, frame)
        except zstandard.ZstdError as e:
            lost = len(self.partial)
            self.partial = ""
            yield self._problem("corrupt", start, f"frame decode failed: {e}" + (f"; an unfinished line of {lost} characters is lost" if lost else ""))
            self.frame += 1
            self.checkpoint = (end, self.frame)
            return
        begun = self.partial
        *lines, self.partial = (begun + text).split("\n")
        for n, line in enumerate(lines):
            line = line.strip(TRIMMED)
            if not line:
                continue
            if is_json(line):
                yield {"row_kind": "line", "frame_index": self.frame, "frame_start": start, "frame_end": end, "line_no": n, "line": line, "valid": True, "record_index": self.records}
                self.records += 1
            else:
                yield self._problem("bad-json", start, "unparsable record")
        if not self.partial:
            self.checkpoint = (end, self.frame + 1)
        elif lines or not begun:
            # The unfinished line begins in this frame.
            self.checkpoint = (start, self.frame)
        self.frame += 1


class _Joined:
    """Bytes in memory, read like a file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def strict_rows(source: bytes | IO[bytes], limit: int | None = None, chunk: int = CHUNK_BYTES) -> Iterator[dict[str, Any]]:
    """Frames and lines for proofs: up to the first byte that isn't a frame, each frame's lines by itself.

    A frame that can't be decoded still has its own row, so damage can't take leaves away. What is held is a
    chunk and the frame that it cuts; behind damage bytes are only counted.
    """
    file = _Joined(source) if isinstance(source, bytes) else source
    left = float("inf") if limit is None else limit

    def read(n: int) -> bytes:
        nonlocal left
        data = file.read(int(min(n, left)))
        left -= len(data)
        return data

    held, base, number, records, over = b"", 0, 0, 0, False
    while not over:
        # A frame of many chunks doubles what is read, so it isn't walked once for each.
        data = read(max(chunk, len(held)))
        over, held = not data, held + data
        spans = boundaries(held)
        for start, end in zip(spans.starts.tolist(), spans.ends.tolist(), strict=True):
            for row in _strict_frame(held, start, end, base, number):
                if row["row_kind"] == "line":
                    row["record_index"] = records if row["valid"] else None
                    records += row["valid"]
                yield row
            number += 1
        at = spans.after(0)
        base, held = base + at, held[at:]
        if isinstance(spans.stop, Corrupt):
            skipped = len(held)
            while data := read(chunk):
                skipped += len(data)
            yield {"row_kind": "diagnostic", "frame_index": number, "frame_start": base, "kind": "corrupt", "detail": spans.stop.reason, "skipped_bytes": skipped}
            return
    if held:
        yield {"row_kind": "diagnostic", "frame_index": number, "frame_start": base, "kind": "corrupt", "detail": "the data end inside a frame", "skipped_bytes": len(held)}


def _strict_frame(held: bytes, start: int, end: int, base: int, number: int) -> Iterator[dict[str, Any]]:
    here = {"frame_index": number, "frame_start": base + start, "frame_end": base + end}
    yield {"row_kind": "frame", **here, "leaf": leaf(held[start:end]), "bytes": end - start}
    try:
        text = text_at(held, start, end)
    except zstandard.ZstdError:
        text = ""
    for n, line in enumerate(text.split("\n")):
        line = line.strip(TRIMMED)
        if line:
            raw = line.encode("utf-8", "surrogatepass")
            yield {"row_kind": "line", **here, "line_no": n, "line": line, "valid": is_json(line), "leaf": leaf(raw), "bytes": len(raw)}


class Follower:
    """One growing log followed without Spark, by a process that keeps its place between polls.

    ``poll`` gives the rows that are new, ``stats`` the counts since the place it began at; ``rewind`` forgets both and
    begins anew, as after a checkpoint that the log no longer fits. A closed follower opens the log again when it polls.
    """

    def __init__(self, path: str, start: int = 0, frame: int = 0, chunk: int = CHUNK_BYTES, ahead: int = READ_AHEAD, most_frame_bytes: int = MOST_FRAME_BYTES):
        self.path, self.budget, self.most = path, chunk * max(1, ahead), most_frame_bytes
        self.file: IO[bytes] | None = None
        self.rewind(start, frame)

    def rewind(self, start: int = 0, frame: int = 0) -> None:
        self.close()
        self.tail, self.at, self.first = Tail(start, frame, self.most), start, frame
        self.problems: list[dict[str, Any]] = []

    def open(self) -> Follower:
        if self.file is None:
            self.file = open_file(self.path)
        return self

    def close(self) -> None:
        file, self.file = self.file, None
        if file is not None:
            file.close()

    __enter__ = open

    def __exit__(self, *_: Any) -> None:
        self.close()

    def poll(self) -> list[dict[str, Any]]:
        """The lines and diagnostics of the next bytes, as many as were allowed; none at the log's present end."""
        self.open().file.seek(self.at)
        data = self.file.read(self.budget)
        self.at += len(data)
        rows = list(self.tail.feed(data))
        self.problems += [r for r in rows if r["row_kind"] == "diagnostic"]
        return rows

    @property
    def at_end(self) -> bool:
        return self.at >= size_of(self.path)

    @property
    def stats(self) -> dict[str, Any]:
        t = self.tail
        return {"frames": t.frame - self.first, "records": t.records, "checkpoint": t.checkpoint, "bytes_read": t.received, "pending_bytes": t.pending, "diagnostics": list(self.problems)}
