"""Audit records of a session: turn starts, tool calls, turn ends and governance events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators import graph
from auditloom.operators.effects import sha256
from auditloom.operators.risk import assess, named, rank

KEY, AT = graph.KEY, graph.AT
#: The fields of a record, in the order of the format.
FIELDS = (
    "session_id", "ts", "kind", "turn", "step", "tool_name", "call_id", "args_digest", "status", "duration_ms", "severity", "flags",
    "summary", "detail", "files_read", "files_written", "network", "actor", "source_type", "source_seq",
)
SOURCE_TYPE = "auditloom"
#: What orders a session's unnumbered records.
ORDER = ("ts", "rank", "o1", "o2")
#: Milliseconds of a stretch in which a session's records are numbered together.
STRETCH = 3_600_000
_UNDECIDABLE = "effect surface is not reconstructible from the log; the command verbatim plus the effect fidelity live in the sidecar"


def call_statements(called: DataFrame) -> DataFrame:
    """Calls with severity, sorted flags, and what they read, wrote and asked of the network.

    A call has one effect, so folding its effects is a projection. An error is medium at least, a call
    without a result high.
    """
    found = assess(called)
    is_error, lonely = F.coalesce(F.col("result.is_error"), F.lit(False)), F.col("result").isNull()
    flags = F.concat("flags", F.filter(F.array(F.when(is_error, "tool-error"), F.when(lonely, "unpaired-call")), lambda x: x.isNotNull()))

    def only(test: Column, value: Column) -> Column:
        return F.when(test & (value != ""), F.array(value)).otherwise(F.array().cast("array<string>"))

    kind = F.col("kind")
    return found.withColumns({
        "severity": named(F.greatest(rank(F.col("severity")), F.when(is_error, 2).otherwise(0), F.when(lonely, 3).otherwise(0))),
        "flags": F.array_sort(F.array_distinct(flags)),
        "files_read": only(kind == "read", F.col("path")), "files_written": only(kind.isin("write", "edit"), F.col("path")), "network": only(kind == "network", F.col("source")),
    })


def summary_line(kind: Column, path: Column, source: Column, tool: Column) -> Column:
    return (
        F.when(kind == "shell", F.concat(F.lit("shell: "), F.substring(F.coalesce(source, F.lit("")), 1, 120)))
        .when(path != "", F.concat(kind, F.lit(" "), path)).when(source != "", F.concat(kind, F.lit(" "), F.substring(source, 1, 80)))
        .otherwise(F.concat(kind, F.lit(" "), tool))
    )


def payloads(records: DataFrame, source_type: str = SOURCE_TYPE, written: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each audit record, with record_id from 1 in the session's order of ts, rank and place.

    Numbering looks at the records twice, as it counts them first. ``written``, if given, puts them into a table in between
    and gives it back, so they are made once.
    """
    every = unnumbered(records, source_type)
    every, one = written(every) if written else every, F.lit(1).cast("long")
    return graph.running_sum(every, "record_id", one, F.floor(F.col("ts") / STRETCH), *ORDER).select(KEY, "record_id", "rank", *FIELDS)


def unnumbered(records: DataFrame, source_type: str = SOURCE_TYPE) -> DataFrame:
    """The audit records without their numbers; rank, o1 and o2 order those of one ts."""
    heads = graph.sessions(graph.of_type(records, "session")).select(F.col(KEY).alias("_key"), F.coalesce("session_id", F.lit("unknown-session")).alias("_session"), F.col("created_at").alias("_created"), F.col("agent_preset").alias("_preset"), F.col("cwd").alias("_cwd"))
    no_list, no_text, no_number = F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("long")

    def rows(frame: DataFrame, rank_: int | Column, order: list[Column], **given: Column) -> DataFrame:
        joined = frame.join(heads, F.col(KEY) == F.col("_key"), "left")
        empty = {"turn": no_number, "step": no_number, "tool_name": no_text, "call_id": no_text, "args_digest": no_text, "status": no_text, "duration_ms": no_number, "severity": F.lit("info"), "flags": no_list, "detail": no_text, "files_read": no_list, "files_written": no_list, "network": no_list, "actor": no_text, "source_type": F.lit(source_type), "source_seq": no_number, "session_id": F.coalesce("_session", F.lit("unknown-session"))}
        columns = empty | given
        first, second = (order + [F.lit(0).cast("long")])[:2]
        return joined.select(F.col(KEY), (rank_ if isinstance(rank_, Column) else F.lit(rank_)).alias("rank"), first.cast("long").alias("o1"), second.cast("long").alias("o2"), *[columns[c].alias(c) for c in FIELDS])

    turn, reason, errors, ends = F.col("turn"), F.col("end_reason"), F.col("errors"), F.col("edge") == 2

    def at_end(end: Column, start: Column) -> Column:
        return F.when(ends, end).otherwise(start)

    # Each turn gives two records from one pass.
    edges = graph.turns(records).withColumn("edge", F.explode(F.array(F.lit(0), F.lit(2))))
    turns = rows(
        edges, F.col("edge"), [turn], ts=at_end(F.coalesce("ended_at", "started_at", F.lit(0).cast("long")), F.coalesce("started_at", "_created", F.lit(0).cast("long"))),
        kind=at_end(F.lit("turn_end"), F.lit("turn_start")), turn=turn, status=at_end(F.coalesce(reason, F.when(F.col("unterminated"), "unterminated").otherwise("completed")), no_text),
        duration_ms=at_end(F.col("duration_ms"), no_number), severity=F.when(ends & (errors > 0), "medium").otherwise("info"),
        flags=F.when(ends & (reason != "") & (reason != "completed"), F.array(F.concat(F.lit("turn:"), reason))).otherwise(no_list),
        summary=F.concat(F.lit("turn "), turn, at_end(F.concat(F.lit(" ended ("), F.coalesce(reason, F.lit("unterminated")), F.lit(")")), F.lit(" started"))),
        detail=F.when(ends & (errors > 0), F.concat(errors, F.lit(" tool error(s) in this turn"))), actor=at_end(no_text, F.col("_preset")),
    )
    # Risk is judged against the session's last working directory; the effects' paths keep their own.
    last_cwd = heads.select(F.col("_key").alias("_k2"), F.col("_cwd").alias("_c2"))
    called = graph.calls(records).join(last_cwd, F.col(KEY) == F.col("_k2"), "left").withColumn("cwd", F.col("_c2")).drop("_k2", "_c2")
    judged = call_statements(called)
    status = F.when(F.col("result").isNull(), "pending").when(F.col("result.is_error"), "error").otherwise("ok")
    tools = rows(
        judged.withColumnRenamed("detail", "effect_detail"), 1, [F.coalesce("seq", "time"), F.col(AT)], ts=F.col("time"), kind=F.lit("tool_call"), turn=turn, step=F.col("step"), tool_name=F.col("name"), call_id=F.col("call_id"),
        args_digest=sha256(F.col("raw_arguments")), status=status, duration_ms=F.col("duration_ms"), severity=F.col("severity"), flags=F.col("flags"),
        summary=F.concat("name", F.lit(": "), summary_line(F.col("kind"), F.col("path"), F.col("source"), F.col("name"))), detail=F.when(F.array_contains("flags", "effects-undecidable"), _UNDECIDABLE),
        files_read=F.col("files_read"), files_written=F.col("files_written"), network=F.col("network"), actor=F.col("_preset"), source_seq=F.col("seq"),
    )
    loud = graph.announced(records).filter(F.col("kind").isin("permission-change", "approval-asked", "approval-denied"))
    governance = rows(
        loud, 3, [F.coalesce("seq", "time", F.lit(0)), F.col("order_index")], ts=F.coalesce("time", F.lit(0).cast("long")), kind=F.lit("session_live"), turn=turn, step=F.col("step"), status=F.col("kind"),
        severity=F.when(F.col("kind") == "approval-denied", "medium").otherwise("high"), flags=F.array("kind"), summary=F.col("detail"), detail=F.col("data"), actor=F.lit("governance"), source_seq=F.col("seq"),
    )
    return turns.unionByName(tools).unionByName(governance)
