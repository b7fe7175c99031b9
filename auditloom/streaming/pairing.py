"""Calls and results paired while a log grows.

State is kept for each call that waits for its result. What a batch read says is final; a stream can only say
that a result hasn't come for some time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditloom.operators.graph import AT, KEY

PAIRED = "session_key string, call_id string, status string, name string, call_index bigint, result_index bigint, is_error boolean, duration_ms bigint"
_STATE = "name string, time bigint, at bigint, paired boolean"


def _pair(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, wait_ms: int) -> Iterator[pd.DataFrame]:
    out: list[dict[str, Any]] = []

    def say(status: str, call: tuple | None, row: Any = None) -> None:
        duration = int(row.time) - call[1] if call and row is not None and row.time and call[1] else None
        out.append({
            "session_key": key[0], "call_id": key[1], "status": status, "name": call[0] if call else None, "call_index": call[2] if call else None,
            "result_index": None if row is None else int(row.record_index), "is_error": None if row is None else bool(row.is_error), "duration_ms": duration,
        })

    call = tuple(state.get) if state.exists else None
    if state.hasTimedOut:
        if call and not call[3]:
            say("unpaired", call)
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values(AT)
        for row in rows.itertuples():
            if row.type == "tool/call":
                if call and not call[3]:
                    say("unpaired", call)
                call = (row.name, int(row.time), int(row.record_index), False)
            elif call:
                say("paired", call, row)
                call = (*call[:3], True)
            else:
                say("orphan", None, row)
        if call:
            state.update(call)
            state.setTimeoutDuration(wait_ms)
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in PAIRED.split(", ")])
    for column in ("call_index", "result_index", "duration_ms"):
        frame[column] = frame[column].astype("Int64")
    frame["is_error"] = frame["is_error"].astype("boolean")
    yield frame


def pair_stream(records: DataFrame, wait_ms: int = 600_000) -> DataFrame:
    """A stream of paired calls, orphan results, and calls without a result for ``wait_ms``."""
    rows = records.filter(F.col("type").isin("tool/call", "tool/result")).select(KEY, "call_id", "type", F.coalesce("name", F.lit("")).alias("tool"), "time", AT, F.coalesce("is_error", F.lit(False)).alias("is_error"))
    named = rows.withColumnRenamed("tool", "name")
    return named.groupBy(KEY, "call_id").applyInPandasWithState(lambda k, b, s: _pair(k, b, s, wait_ms), PAIRED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def calls_by_window(records: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls by tool in windows of event time; rows later than ``late`` are dropped."""
    timed = records.filter("type = 'tool/call'").select(F.timestamp_millis("time").alias("at"), "name")
    return timed.withWatermark("at", late).groupBy(F.window("at", width), "name").agg(F.count(F.lit(1)).alias("calls")).select("window.start", "window.end", "name", "calls")
