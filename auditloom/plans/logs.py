"""Sessions of the adapter written as real logs: one file for each session, frames of JSON lines."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from auditloom.sources.sessionlog import LOG_NAME
from auditloom.sources.store import store_of

#: Lines of a frame.
LINES = 16
_ARGUMENTS = json.JSONEncoder(ensure_ascii=False).encode
_LINE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
#: What ``as_line`` writes of a record, and what orders it.
WRITTEN = ("session_key", "record_index", "type", "seq", "time", "turn", "step", "session_id", "created_at", "cwd", "agent_preset", "call_id", "name", "args", "is_error", "text")


def as_line(row: dict[str, Any]) -> dict[str, Any] | None:
    """A typed record as the log has it; only headers, calls and results."""
    kind, head = row["type"], {"type": row["type"], "seq": row["seq"], "time": row["time"]}
    if kind == "session":
        return {"type": kind, "version": 1, "id": row["session_id"], "createdAt": row["created_at"], "cwd": row["cwd"], "agentPreset": row["agent_preset"]}
    if kind == "tool/call":
        return head | {"data": {"turn": row["turn"], "step": row["step"], "callId": row["call_id"], "name": row["name"], "arguments": _ARGUMENTS(dict(row["args"]))}}
    if kind == "tool/result":
        return head | {"data": {"message": {"source": {"callId": row["call_id"]}, "content": [{"isError": row["is_error"], "content": [{"type": "text", "text": row["text"]}]}]}}}
    return None


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor().compress
    session, out, held, counts = None, None, [], {}

    def flush() -> None:
        if held:
            out.write(compress(("\n".join(held) + "\n").encode()))
            held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            if row["session_key"] != session:
                if out is not None:
                    flush()
                    out.close()
                session = row["session_key"]
                store, inside = store_of(f"{folder}/sessions/adapter/{session}/{LOG_NAME}")
                store.create_dir(inside.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(inside)
            line = as_line(row)
            if line is not None:
                held.append(_LINE(line))
                counts[session] = counts.get(session, 0) + 1
            if len(held) == LINES:
                flush()
    if out is not None:
        flush()
        out.close()
    yield pa.RecordBatch.from_pydict({"session_key": pa.array(list(counts), pa.string()), "lines": pa.array(list(counts.values()), pa.int64())})


def write_logs(records: DataFrame, folder: str) -> int:
    """Write each session's log below ``folder``; the number of lines. A task that runs again writes the same files."""
    own = records.filter("type in ('session', 'tool/call', 'tool/result')").select(*WRITTEN).repartition("session_key").sortWithinPartitions("session_key", "record_index")
    done = own.mapInArrow(lambda it: _write(it, folder), "session_key string, lines bigint")
    return done.groupBy().sum("lines").first()[0] or 0
