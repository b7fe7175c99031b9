"""From lines of JSON to typed records.

A record is narrowed once, by one function over Arrow batches; all later operators are relational and
never look at JSON again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.jsonish import dump, number, parse, printed, string, utf16_length
from auditloom.schemas import RECORDS, STREAMING, TRIMMED

_FIELDS = [f.name for f in RECORDS.fields if f.name not in ("session_key", "record_index", "frame_index", "frame_start")]
_SETTINGS = {"permission/preset": "preset", "sandbox/mode": "mode", "approval/policy": "policy"}


def _object(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def _blocks(value: Any) -> list[dict]:
    return [_object(b) for b in value] if isinstance(value, list) else []


def _texts(value: Any) -> list[tuple[int, str]]:
    """The texts of a list of content blocks, with their places."""
    return [(i, b["text"]) for i, b in enumerate(_blocks(value)) if b.get("type") == "text" and isinstance(b.get("text"), str)]


def _arguments(raw: str) -> dict[str, Any]:
    """A call's arguments: their state, string values by name, and all of them as JSON."""
    state, value = "ok", {}
    if raw.strip(TRIMMED):
        try:
            got = parse(raw)
            if isinstance(got, (dict, list)):
                value = got
            else:
                state = "not-object"
        except ValueError:
            state = "invalid"
    known = _object(value)
    args = {k: v for k, v in known.items() if isinstance(v, str)}
    for key in ("offset", "limit"):
        if isinstance(known.get(key), (int, float)) and not isinstance(known[key], bool):
            args[f"#{key}"] = dump(known[key])
    if known.get("include"):
        args["#include"] = printed(known["include"])
    return {"arguments_state": state, "args": list(args.items()), "args_json": dump(value), "replace_all": known.get("replace_all") is True or known.get("replaceAll") is True}


def _present(data: dict, names: dict[str, str]) -> str:
    """JSON of those fields that are there, keys sorted."""
    return dump({out: data[key] for out, key in names.items() if key in data}, ordered=True)


def narrow(value: Any) -> dict[str, Any]:
    """The typed fields of one parsed line."""
    record = _object(value)
    kind = string(record.get("type"))
    if not kind:
        return {"valid": False}
    data = _object(record.get("data"))
    out: dict[str, Any] = {"valid": True, "type": kind}
    if kind in STREAMING:
        parts = data.get("texts") if isinstance(data.get("texts"), list) else []
        out["stream_chars"] = sum(utf16_length(t) for t in [*parts, data.get("text")] if isinstance(t, str))
        return out
    seq, time = number(record.get("seq")), number(record.get("time"))
    out["seq"] = seq if seq is not None else number(record.get("seq0"))
    out["time"] = time if time is not None else number(record.get("time0")) or 0
    out["turn"], out["step"] = number(data.get("turn")), number(data.get("step"))
    message = _object(data.get("message"))
    source = _object(message.get("source"))
    if kind == "session":
        out |= {"session_id": string(record.get("id")), "created_at": number(record.get("createdAt")), "cwd": string(record.get("cwd"))}
        out |= {"delegation_depth": number(record.get("delegationDepth")), "agent_preset": string(record.get("agentPreset"))}
    elif kind in _SETTINGS:
        out["setting"] = string(data.get(_SETTINGS[kind])) or None
    elif kind == "turn/end":
        out["end_reason"] = string(_object(data.get("reason")).get("kind"))
    elif kind == "user/message":
        out["text"] = "".join(t for _, t in _texts(data.get("content")))
    elif kind == "assistant/message":
        out |= {"message_id": string(message.get("id")) or None, "model": string(source.get("model")) or ("" if source.get("model") == "" else "(unknown)"), "texts": _texts(message.get("content"))}
        if data.get("usage"):
            usage = _object(data["usage"])
            out["usage"] = {o: number(usage.get(k)) or 0 for o, k in (("input_tokens", "inputTokens"), ("output_tokens", "outputTokens"), ("cache_read_tokens", "cacheReadTokens"), ("reasoning_tokens", "reasoningTokens"))}
    elif kind == "tool/call":
        raw = string(data.get("arguments")) or ""
        name = string(data.get("name"))
        out |= {"call_id": string(data.get("callId")) or "", "name": "(unknown)" if name is None else name, "raw_arguments": raw} | _arguments(raw)
        out["detail"] = printed(data.get("name"))
    elif kind == "tool/result":
        blocks = _blocks(message.get("content"))
        out |= {"call_id": string(source.get("callId")) or "", "is_error": any(b.get("isError") is True for b in blocks), "text": "".join(t for b in blocks for _, t in _texts(b.get("content")))}
    elif kind == "approval/asked":
        out |= {"detail": f"approval requested for {printed(data.get('toolName'))}", "data": _present(data, {"id": "id", "callId": "callId", "reason": "reason"})}
    elif kind == "approval/decided":
        out |= {"outcome": string(data.get("outcome")) if isinstance(data.get("outcome"), str) else "unknown", "data": _present(data, {"id": "id"})}
    elif kind == "command/run":
        args = printed(data.get("args"), "").strip(TRIMMED)
        out |= {"name": string(data.get("name")), "detail": f"permission preset changed to {args}", "data": _present(data, {"commandId": "commandId", "args": "args"})}
    elif kind == "compaction/start":
        out |= {"detail": f"context compaction started in turn {printed(data.get('turn'), '?')}", "data": _present(data, {"compactionId": "compactionId"})}
    elif kind == "llm/retry":
        failure = _object(data.get("failure"))
        merged = {**{k: data[k] for k in ("retryId", "delayMs") if k in data}, **{k: failure[k] for k in ("code", "message") if k in failure}}
        out |= {"detail": f"retry {printed(data.get('retry'))}/{printed(data.get('maxRetries'))} after {printed(failure.get('code'), 'error')}", "data": dump(merged, ordered=True)}
    return out


def _types() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(RECORDS)


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _types()
    for batch in batches:
        rows = []
        for line in batch.column(4).to_pylist():
            try:
                rows.append(narrow(parse(line)))
            except ValueError:
                rows.append({"valid": None})
        columns, known = list(batch.columns[:4]), set().union(*rows)
        for name in _FIELDS:
            kind = schema.field(name).type
            columns.append(pa.array([r.get(name) for r in rows], kind) if name in known else pa.nulls(len(rows), kind))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def typed(lines: DataFrame) -> DataFrame:
    """Records of lines (session_key, record_index, frame_index, frame_start, line).

    ``valid`` is true for an object with a type, false for other JSON, null for a line that isn't JSON.
    """
    return lines.select("session_key", F.col("record_index").cast("long"), F.col("frame_index").cast("long"), F.col("frame_start").cast("long"), "line").mapInArrow(_narrowed, RECORDS)


def prefix_metadata(lines: DataFrame, limit: int = 4096) -> DataFrame:
    """type, seq and session id from the beginning of a line alone, without parsing it.

    Only lines that begin with the type, and have seq or seq0 right behind it, give them.
    """
    head = F.substring("line", 1, limit)

    def group(pattern: str):
        return F.when(head.rlike(pattern), F.regexp_extract(head, pattern, 1))

    return lines.select(
        "*",
        group(r'^\{"type":"([^"]{1,64})"').alias("meta_type"),
        group(r'^\{"type":"[^"]{1,64}","(?:seq|seq0)":(\d{1,15})').cast("long").alias("meta_seq"),
        group(r'^\{"type":"session","version":\d+,"id":"([^"]{1,128})"').alias("meta_session_id"),
    )
