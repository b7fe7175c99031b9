"""Synthetic session logs: one zstd frame for each record."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

import zstandard


def frame(*records: Any, text: str | None = None) -> bytes:
    body = text if text is not None else "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n" for r in records)
    return zstandard.ZstdCompressor().compress(body.encode("utf-8", "surrogatepass"))


def skippable(payload: bytes) -> bytes:
    return (0x184D2A50).to_bytes(4, "little") + len(payload).to_bytes(4, "little") + payload


def log(records: Iterable[Any]) -> bytes:
    return b"".join(frame(r) for r in records)


def session_records(turns: int = 12, steps: int = 3, cwd: str = "/work/project", session: str = "synthetic-session") -> list[dict]:
    """A session with a tool call, its result and an assistant message in every step, a retry and a compaction."""
    tools = [
        ("write", {"file_path": "src/new.txt", "content": "hello"}), ("edit", {"file_path": "src/old.txt", "old_string": "a", "new_string": "bb"}),
        ("read", {"file_path": "src/old.txt", "offset": 3}), ("grep", {"pattern": "x\"y", "path": "src"}),
        ("bash", {"command": "ls -la"}), ("web_search", {"query": "spark"}),
    ]
    seq, now, out = 0, 1_700_000_000_000, []

    def add(kind: str, data: dict) -> None:
        nonlocal seq, now
        seq, now = seq + 1, now + 50
        out.append({"type": kind, "seq": seq, "time": now, "data": data})

    out.append({"type": "session", "version": 1, "id": session, "createdAt": now, "cwd": cwd, "delegationDepth": 0, "agentPreset": "default"})
    add("permission/preset", {"preset": "ask"})
    add("sandbox/mode", {"mode": "workspace"})
    add("command/run", {"commandId": "c1", "name": "permission", "args": "auto", "source": {"kind": "user"}})
    for t in range(1, turns + 1):
        add("turn/start", {"turn": t})
        add("user/message", {"role": "user", "id": f"u{t}", "content": [{"type": "text", "text": f"do step {t}"}]})
        for s in range(1, steps + 1):
            name, args = tools[(t * steps + s) % len(tools)]
            call = f"call-{t}-{s}"
            add("step/start", {"turn": t, "step": s})
            add("assistant/message", {"turn": t, "step": s, "message": {"role": "assistant", "id": f"m{t}-{s}", "content": [{"type": "text", "text": "ok"}], "source": {"kind": "model", "model": "m-1"}}, "usage": {"inputTokens": 10, "outputTokens": 5, "cacheReadTokens": 2, "reasoningTokens": 1}})
            add("tool/call", {"turn": t, "step": s, "callId": call, "name": name, "arguments": json.dumps(args)})
            add("tool/result", {"turn": t, "step": s, "message": {"source": {"kind": "tool", "callId": call}, "content": [{"type": "tool-result", "content": [{"type": "text", "text": "done"}], "isError": (t + s) % 9 == 0}]}})
            add("step/end", {"turn": t, "step": s})
        add("turn/end", {"turn": t, "reason": {"kind": "completed"}})
    add("llm/retry", {"retryId": "r1", "turn": 1, "step": 1, "retry": 1, "maxRetries": 3, "failure": {"code": "overloaded", "message": "busy"}, "delayMs": 100})
    add("compaction/start", {"compactionId": "k1", "turn": 2})
    return out
