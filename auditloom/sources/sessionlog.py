"""The ``sessionlog`` data source: batch and streaming reads of multi-frame zstd logs.

Options: ``path`` (a log, or a folder of logs), ``mode`` (``tail``: lines may reach over frames and damage is
skipped; ``strict``: rows for proofs), ``chunkBytes``, ``readAheadChunks``, ``maxFrameBytes``, ``maxBytes``
(strict: the beginning of a log only), ``from`` (a byte offset to begin at), ``logName`` (of files in folders),
``packBytes`` and ``tasks`` (how small logs share a task).

A log is read by one task, as frames can be found only from the start; small logs share tasks of up to ``packBytes``, but at
least ``tasks`` tasks are made as long as there are logs. A stream's offset has for each log the byte and the
ordinal of the frame to go on from; the logs of a micro-batch are decoded on the executors, the driver
walks the boundaries of new frames, of several logs at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from auditloom.plans.workers import reach
from auditloom.schemas import LINES
from auditloom.sources.frames import Corrupt, Incomplete, boundaries, next_magic, text_at
from auditloom.sources.store import files_under, open_file
from auditloom.sources.tail import CHUNK_BYTES, MOST_FRAME_BYTES, READ_AHEAD, Tail, strict_rows

LOG_NAME = "session.jsonl.zstd"
_BATCH = 4096
#: Bytes of small logs in a task, tasks to make at least, bytes that opening a log is worth, logs walked at a time.
PACK_BYTES, TASKS, OPEN_COST, WALKERS = 64 << 20, 200, 1 << 16, 16


class LogPart:
    """A log, or what a micro-batch reads of it."""

    def __init__(self, path: str, start: int = 0, frame: int = 0, end: int | None = None):
        self.path, self.start, self.frame, self.end = path, start, frame, end


class LogParts(InputPartition):
    """The logs of a task."""

    def __init__(self, parts: list[LogPart]):
        self.parts = parts


def packed(sized: Iterable[tuple[LogPart, int]], most: int, tasks: int) -> list[LogParts]:
    """Logs in tasks of up to ``most`` bytes, each log in one; fewer bytes where that gives less than ``tasks`` tasks."""
    logs = [(part, size + OPEN_COST) for part, size in sized]
    target = min(most, -(-sum(cost for _, cost in logs) // max(1, tasks)))
    out: list[list[LogPart]] = []
    held = target
    for part, cost in logs:
        if held + cost > target:
            out.append([])
            held = 0
        out[-1].append(part)
        held += cost
    return [LogParts(parts) for parts in out]


class Options:
    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        self.path = low.get("path", "")
        self.mode = low.get("mode", "tail")
        if self.mode not in ("tail", "strict"):
            raise ValueError(f"mode must be tail or strict, not {self.mode}")
        self.chunk = int(low.get("chunkbytes", CHUNK_BYTES))
        self.ahead = int(low.get("readaheadchunks", READ_AHEAD))
        self.most = int(low.get("maxframebytes", MOST_FRAME_BYTES))
        self.limit = int(low["maxbytes"]) if "maxbytes" in low else None
        self.start = int(low.get("from", 0))
        self.name = low.get("logname", LOG_NAME)
        self.pack, self.tasks = int(low.get("packbytes", PACK_BYTES)), int(low.get("tasks", TASKS))

    def files(self) -> list[tuple[str, int]]:
        return files_under(self.path, self.name)


def read_part(part: LogPart, options: Options) -> Iterator[dict[str, Any]]:
    """The rows of one log, in bounded memory."""
    with open_file(part.path) as f:
        if options.mode == "strict":
            yield from strict_rows(f, options.limit, options.chunk)
            return
        f.seek(part.start)
        tail, left = Tail(part.start, part.frame, options.most), None if part.end is None else part.end - part.start
        while left is None or left > 0:
            data = f.read(options.chunk if left is None else min(options.chunk, left))
            if not data:
                return
            left = None if left is None else left - len(data)
            yield from tail.feed(data)


def _batches(parts: Iterable[LogPart], options: Options, dense: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a task's logs; a batch reaches over many small ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(LINES)
    held: list[dict[str, Any]] = []

    def batch() -> pa.RecordBatch:
        known = set().union(*held)
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in held], f.type) if f.name in known else pa.nulls(len(held), f.type) for f in schema], schema=schema)

    for part in parts:
        for row in read_part(part, options):
            row["path"] = part.path
            if not dense and row.get("record_index") is not None:
                row["record_index"] = (row["frame_index"] << 24) + row["line_no"]
            held.append(row)
            if len(held) == _BATCH:
                yield batch()
                held = []
    if held:
        yield batch()


class LogReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[LogParts]:
        logs = [(LogPart(p, self.options.start), size) for p, size in self.options.files()]
        return packed(logs, self.options.pack, self.options.tasks)

    def read(self, partition: LogParts | None) -> Iterator[pa.RecordBatch]:
        return _batches(partition.parts if partition else (), self.options, dense=True)


def complete_until(path: str, start: int, frame: int, options: Options) -> tuple[int, int]:
    """How far a log can be consumed: behind its last complete frame that leaves no unfinished line.

    Boundaries are walked without decoding; only the last frames are decoded, back to one that ends a line.
    """
    budget = options.chunk * options.ahead
    with open_file(path) as f:
        while True:
            f.seek(start)
            data = f.read(budget)
            at, spans, found = 0, [], None
            while True:
                starts, ends, found = boundaries(data, at)
                spans += zip(starts.tolist(), ends.tolist(), strict=True)
                at = spans[-1][1] if len(starts) else at
                if not isinstance(found, Corrupt) or (n := next_magic(data, at + 1)) < 0:
                    break
                at = n
            used = len(spans)
            while used and spans[used - 1][1] == at and not _ends_line(data, *spans[used - 1]):
                used -= 1
                at = spans[used][0]
            if at and len(data) == budget:
                # There may be more, which is walked from here: a long log is never held as a whole.
                start, frame, budget = start + at, frame + used, options.chunk * options.ahead
                continue
            if at or len(data) < budget or isinstance(found, Corrupt):
                if not at and isinstance(found, Corrupt):
                    return start, frame
                return start + at, frame + used
            if isinstance(found, Incomplete) and len(data) > options.most:
                return start + len(data), frame
            budget *= 2  # one frame, or one line, is longer than what was read


def _ends_line(data: bytes, start: int, end: int) -> bool:
    try:
        text = text_at(data, start, end)
    except Exception:  # what can't be decoded holds no line back
        return True
    return not text or text.endswith("\n")


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: Options):
        self.options = options
        self.last: dict[str, list[int]] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of all complete frames. A stream that starts anew walks its logs from their beginning once, so an
        offset never falls behind one that was recorded before."""
        now = dict(self.last or {})
        grown = [(path, *now.get(path, (self.options.start, 0))) for path, size in self.options.files() if size > now.get(path, (self.options.start, 0))[0]]
        with ThreadPoolExecutor(WALKERS) as pool:
            ends = list(pool.map(lambda log: complete_until(*log, self.options), grown))
        now |= {path: list(end) for (path, _, _), end in zip(grown, ends, strict=True)}
        self.last = now
        return now

    def partitions(self, start: dict, end: dict) -> list[LogParts]:
        spans = [(path, *start.get(path, (self.options.start, 0)), stop) for path, (stop, _) in sorted(end.items())]
        return packed([(LogPart(path, begin, frame, stop), stop - begin) for path, begin, frame, stop in spans if stop > begin], self.options.pack, self.options.tasks)

    def read(self, partition: LogParts | None) -> Iterator[pa.RecordBatch]:
        return _batches(partition.parts if partition else (), self.options, dense=False)

    def commit(self, end: dict) -> None:
        return None


class SessionLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sessionlog"

    def schema(self):
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return LogReader(Options(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(Options(dict(self.options)))


def register(spark: SparkSession) -> None:
    reach(spark)
    spark.dataSource.register(SessionLogSource)
