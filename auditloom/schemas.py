"""Record layout, entity schemas and the fixed values of the log format."""

from __future__ import annotations

from pyspark.sql import types as T

#: Record types that stream parts of a message; they are counted, never kept.
STREAMING = ("assistant/chunk", "reasoning-chunks", "tool-call-chunks", "text-chunks")
#: Severities from the least to the most severe.
SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Kinds of effects, and how faithfully a log records one.
EFFECT_KINDS = ("read", "write", "edit", "search", "shell", "network", "delegation", "control", "unknown")
FIDELITIES = ("exact", "partial", "observed", "undecidable", "opaque")
#: Kinds of anomalies, of audit records, of manifest mismatches and of reader diagnostics.
ANOMALIES = ("turn-aborted", "tool-error", "orphan-tool-result", "unpaired-tool-call", "approval-asked", "approval-denied", "permission-change", "compaction", "llm-retry")
AUDIT_KINDS = (
    "session_live", "turn_start", "turn_end", "step_start", "step_end", "user_message", "assistant_message", "assistant_chunk",
    "todo_update", "request_header", "request_context", "tool_call", "tool_result", "tool_dispatch", "tool_registered",
)
MISMATCHES = ("bytes", "frames", "records", "frameRoot", "recordRoot")
DIAGNOSTICS = ("corrupt", "oversize-frame", "bad-json")
#: The interchange format of chained audit documents.
COMPLIANCE_SCHEMA = "dsh-audit-trail/compliance/1"
CANONICAL_PREFIX = "dsh-audit-trail/canonical/1"
#: White space that ends a line or a text is trimmed of: Unicode's, and the byte order mark.
TRIMMED = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as a class of a regular expression.
TRIM_CLASS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def _struct(spec: str, **nested: T.DataType) -> T.StructType:
    """A struct type from "name type, ..."; workers have no parser for this in reach."""
    pairs = (x.split() for x in spec.split(","))
    return T.StructType([T.StructField(name, nested.get(kind) or _KINDS[kind]) for name, kind in pairs])


USAGE = _struct("input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, reasoning_tokens bigint")

#: One row for each line of a log. ``session_key`` tells sessions apart and record_index orders a
#: session's rows. A field of the wrong JSON type is null, never converted.
RECORDS = _struct(
    """session_key string, record_index bigint, frame_index bigint, frame_start bigint, valid boolean, type string, seq bigint, time bigint,
    turn bigint, step bigint, session_id string, created_at bigint, cwd string, delegation_depth bigint, agent_preset string,
    setting string, end_reason string, text string, texts texts, message_id string, model string, usage usage,
    call_id string, name string, raw_arguments string, arguments_state string, args args, args_json string, replace_all boolean,
    is_error boolean, outcome string, detail string, data string, stream_chars bigint""",
    texts=T.ArrayType(_struct("pos int, text string")), usage=USAGE, args=T.MapType(T.StringType(), T.StringType()),
)

#: What the log source yields: a line with its place, or a diagnostic, or a frame.
LINES = _struct(
    """path string, row_kind string, frame_index bigint, frame_start bigint, frame_end bigint, line_no int, line string, valid boolean, kind string, detail string,
    skipped_bytes bigint, record_index bigint, leaf binary, bytes bigint"""
)

SEVERITY_RANK = {s: i for i, s in enumerate(SEVERITIES)}
