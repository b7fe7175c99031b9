"""Turns, steps, calls, usage and anomalies of sessions, from typed records.

Order is never that of a DataFrame: ``record_index`` decides everywhere. What the most recent earlier record
of a key says is found by windows over that key alone, so a session that holds a large part of all
rows is still spread over its calls, turns and steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.effects import effects_of
from auditloom.schemas import STREAMING

KEY, AT = "session_key", "record_index"
#: Places of a stretch of a session.
SPAN = 65_536
_USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "reasoning_tokens")


def _upto(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(rows: DataFrame, name: str, value: Column, stretch: Column, *order: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over their session's rows up to them, in order.

    ``stretch`` never falls along the order. Sums run within a session's stretches, and what each adds up to is carried
    on by a table with a row for each stretch: a session with a large part of all rows is many tasks.
    """
    cut = rows.withColumns({"_stretch": F.coalesce(stretch.cast("long"), F.lit(-(1 << 62))), "_value": value})
    sums = cut.groupBy(F.col(KEY).alias("_of"), F.col("_stretch").alias("_at")).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_of", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    own = F.sum("_value").over(Window.partitionBy(KEY, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("_own", own).join(carried, F.col(KEY).eqNullSafe(F.col("_of")) & (F.col("_stretch") == F.col("_at")))
    return joined.withColumn(name, F.col("_own") + F.col("_carried")).drop("_stretch", "_value", "_of", "_at", "_carried", "_own")


def valid(records: DataFrame) -> DataFrame:
    """Objects with a type."""
    return records.filter("valid")


def of_type(records: DataFrame, *types: str) -> DataFrame:
    return valid(records).filter(F.col("type").isin(*types))


def type_counts(records: DataFrame, *by: str) -> DataFrame:
    return valid(records).groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))


def stats(records: DataFrame) -> DataFrame:
    """Per session: records, parsed, unparsable, streaming records and their characters, calls, results."""
    streaming = F.col("type").isin(*STREAMING)
    return records.filter("valid is not null").groupBy(KEY).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("valid").alias("parsed"), F.count_if(~F.col("valid")).alias("unparsable"),
        F.count_if(streaming).alias("streaming_records"), F.sum(F.coalesce("stream_chars", F.lit(0))).alias("reasoning_chars"),
        F.count_if(F.col("type") == "tool/call").alias("tool_calls"), F.count_if(F.col("type") == "tool/result").alias("tool_results"),
    )


def sessions(records: DataFrame) -> DataFrame:
    """Per session: the last header's fields, and the first and last governance settings that aren't empty."""
    first_last = []
    for kind, name in (("permission/preset", "permission_preset"), ("sandbox/mode", "sandbox_mode"), ("approval/policy", "approval_policy")):
        here = F.when((F.col("type") == kind) & F.col("setting").isNotNull(), F.col(AT))
        first_last += [F.min_by("setting", here).alias(name), F.max_by("setting", here).alias(f"{name}_final")]
    header = F.max_by(F.struct("session_id", "created_at", "cwd", "delegation_depth", "agent_preset"), F.when(F.col("type") == "session", F.col(AT))).alias("h")
    return valid(records).groupBy(KEY).agg(header, *first_last).select(KEY, "h.*", *[c for n in ("permission_preset", "sandbox_mode", "approval_policy") for c in (n, f"{n}_final")])


def with_cwd(rows: DataFrame, records: DataFrame) -> DataFrame:
    """``rows`` with the working directory that the last session header before them gave.

    Headers are few: each reigns from its place to the next one's, and rows join the reign they fall in.
    """
    headers = of_type(records, "session").select(KEY, F.col(AT).alias("since"), F.col("cwd"))
    reigns = headers.withColumn("until", F.lead("since").over(Window.partitionBy(KEY).orderBy("since"))).withColumnRenamed(KEY, "_key")
    inside = (F.col(KEY) == F.col("_key")) & (F.col(AT) > F.col("since")) & (F.col("until").isNull() | (F.col(AT) < F.col("until")))
    return rows.drop("cwd").join(reigns, inside, "left").drop("_key", "since", "until")


def calls_and_results(records: DataFrame) -> DataFrame:
    """Calls and results together; ``call_at`` is the place of the latest call with the row's id so far."""
    both = of_type(records, "tool/call", "tool/result")
    is_call = F.col("type") == "tool/call"
    latest = F.last(F.when(is_call, F.struct(F.col(AT).alias("at"), "name", "time", "turn", "step")), ignorenulls=True).over(_upto(KEY, "call_id"))
    return both.withColumn("call", latest).withColumn("call_at", F.col("call.at"))


def results(records: DataFrame) -> DataFrame:
    """Each result with the call it is bound to, null for a result that no earlier call has asked for."""
    rows = calls_and_results(records).filter(F.col("type") == "tool/result")
    return rows.select(
        KEY, AT, "frame_index", "frame_start", "seq", "time", "call_id", "is_error", "text", F.octet_length("text").cast("long").alias("text_bytes"),
        "call_at", F.col("call.name").alias("call_name"), F.col("call.time").alias("call_time"), _or_zero("call.turn").alias("call_turn"), _or_zero("call.step").alias("call_step"),
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


def calls(records: DataFrame) -> DataFrame:
    """One row for each call, with its last result (null without one), duration and effect.

    The duration is missing where either time is 0. A call is bound to results up to the next call with
    its id. Calls meet their results in one shuffle: a call is a row of its own group.
    """
    rows = calls_and_results(records).filter("call_at is not null")
    is_call, is_result = F.col("type") == "tool/call", F.col("type") == "tool/result"
    own = ("name", "raw_arguments", "arguments_state", "args", "args_json", "replace_all", "turn", "step", "seq", "time", "frame_index", "frame_start")
    result = F.struct("is_error", "text", F.octet_length("text").cast("long").alias("text_bytes"), "time", "seq", "frame_index")
    grouped = rows.groupBy(KEY, "call_id", F.col("call_at").alias(AT)).agg(
        F.max_by(F.struct(*own), F.when(is_call, F.col(AT))).alias("c"), F.max_by(result, F.when(is_result, F.col(AT))).alias("result"),
        F.max_by("time", F.when(is_result & (F.col("time") != 0), F.col(AT))).alias("until"),
    )
    duration = F.when((F.col("c.time") != 0) & F.col("until").isNotNull(), F.col("until") - F.col("c.time"))
    fields = [_or_zero(f"c.{f}").alias(f) if f in ("turn", "step") else F.col(f"c.{f}") for f in own]
    return effects_of(with_cwd(grouped.select(KEY, AT, "call_id", *fields, "result", duration.alias("duration_ms")), records))


def effects(called: DataFrame) -> DataFrame:
    """The effects of calls, in their own table."""
    return called.select(
        KEY, AT, "call_id", F.col("name").alias("tool_name"), "turn", "step", "seq", "time", "frame_index", "frame_start",
        "kind", "fidelity", "raw_path", "path", "content_hash", "bytes", "source", "detail", "undecidable", "cwd",
    )


def unpaired_calls(called: DataFrame) -> DataFrame:
    return called.filter("result is null")


def orphan_results(records: DataFrame) -> DataFrame:
    return results(records).filter("call_at is null")


def tool_call_stats(called: DataFrame) -> DataFrame:
    """Per tool: calls, paired calls, errors, mean and longest duration."""
    return called.groupBy("name").agg(
        F.count(F.lit(1)).alias("calls"), F.count("result").alias("paired"), F.count_if(F.col("result.is_error")).alias("errors"),
        F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"),
    )


def messages(records: DataFrame) -> DataFrame:
    """Assistant messages, those with an id once a session: the first."""
    said = of_type(records, "assistant/message").withColumns({"turn": _or_zero("turn"), "step": _or_zero("step")})
    number = F.row_number().over(Window.partitionBy(KEY, F.coalesce("message_id", F.concat(F.lit("\x00"), F.col(AT)))).orderBy(AT))
    return said.withColumn("_n", number).filter("_n = 1").drop("_n")


def usage(said: DataFrame, *by: str) -> DataFrame:
    """Token usage of messages by session, turn or model; a group without any usage has zeros."""
    sums = [F.coalesce(F.sum(f"usage.{c}"), F.lit(0)).alias(c) for c in _USAGE]
    return said.groupBy(KEY, *by).agg(*sums, F.count("usage").alias("messages"))


def usage_all(said: DataFrame) -> DataFrame:
    """All three grains in one pass: session (turn and model null), turn and model."""
    said.createOrReplaceTempView("auditloom_messages")
    sums = ", ".join(f"coalesce(sum(usage.{c}), 0) as {c}" for c in _USAGE)
    return said.sparkSession.sql(f"""select {KEY}, turn, model, grouping_id() as grain, {sums}, count(usage) as messages from auditloom_messages
        group by grouping sets (({KEY}), ({KEY}, turn), ({KEY}, model))""")


def assistant_texts(said: DataFrame) -> DataFrame:
    return said.select(KEY, AT, "turn", "step", "message_id", F.explode("texts").alias("t")).select(KEY, AT, "turn", "step", "message_id", F.col("t.pos").alias("block_pos"), F.col("t.text").alias("text"))


def _turn_events(records: DataFrame) -> DataFrame:
    """Every event that makes a turn known."""
    known = of_type(records, "turn/start", "turn/end", "step/start", "tool/call").select(KEY, AT, "type", "time", _or_zero("turn").alias("turn"), "end_reason")
    return known.unionByName(messages(records).select(KEY, AT, "type", "time", "turn", "end_reason"))


def turns(records: DataFrame) -> DataFrame:
    """Per turn: last start, last end with its reason, duration, errors, calls and usage."""
    events = _turn_events(records)
    start, end = F.col("type") == "turn/start", F.col("type") == "turn/end"
    began = F.last(F.when(start, F.col("time")), ignorenulls=True).over(_upto(KEY, "turn"))
    seen = events.withColumn("began", F.when(end, began))
    nodes = seen.groupBy(KEY, "turn").agg(
        F.max_by("time", F.when(start, F.col(AT))).alias("started_at"), F.max_by(F.struct("time", "end_reason", "began"), F.when(end, F.col(AT))).alias("e"),
        F.count_if(F.col("type") == "tool/call").alias("n_calls"), F.min(AT).alias("first_at"),
    )
    errors = turn_errors(records).withColumnRenamed("errors", "_errors")
    used = usage(messages(records), "turn")
    joined = nodes.join(errors, [KEY, "turn"], "left").join(used, [KEY, "turn"], "left")
    counters = [F.coalesce(c, F.lit(0)).alias(c) for c in (*_USAGE, "messages")]
    return joined.select(
        KEY, "turn", "first_at", "started_at", F.col("e.time").alias("ended_at"), (F.col("e.time") - F.col("e.began")).alias("duration_ms"), F.col("e.end_reason").alias("end_reason"),
        F.col("e").isNull().alias("unterminated"), F.coalesce("_errors", F.lit(0)).alias("errors"), "n_calls", *counters,
    )


def turn_errors(records: DataFrame) -> DataFrame:
    """Errors by the turn of the call; every bound result that is an error counts."""
    return results(records).filter("call_at is not null and is_error").groupBy(KEY, F.col("call_turn").alias("turn")).agg(F.count(F.lit(1)).alias("errors"))


def steps(records: DataFrame) -> DataFrame:
    """One row for each step/start; ends and calls belong to the latest start of their turn and step."""
    events = of_type(records, "step/start", "step/end", "tool/call").select(KEY, AT, "type", "time", _or_zero("turn").alias("turn"), _or_zero("step").alias("step"))
    node = F.last(F.when(F.col("type") == "step/start", F.col(AT)), ignorenulls=True).over(_upto(KEY, "turn", "step"))
    grouped = events.withColumn("node", node).filter("node is not null").groupBy(KEY, "turn", "step", "node").agg(
        F.min_by("time", F.when(F.col("type") == "step/start", F.col(AT))).alias("started_at"),
        F.max_by("time", F.when(F.col("type") == "step/end", F.col(AT))).alias("ended_at"), F.count_if(F.col("type") == "tool/call").alias("n_calls"),
    )
    return grouped.select(KEY, "turn", "step", F.col("node").alias("start_index"), "started_at", "ended_at", (F.col("ended_at") - F.col("started_at")).alias("duration_ms"), F.col("ended_at").isNull().alias("unterminated"), "n_calls")


def user_messages(records: DataFrame) -> DataFrame:
    """User messages; their turn is the number of turns known before them."""
    first = _turn_events(records).groupBy(KEY, "turn").agg(F.min(AT).alias(AT)).select(KEY, AT, F.lit(1).alias("new"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("time"))
    said = of_type(records, "user/message").select(KEY, AT, F.lit(0).alias("new"), F.coalesce("text", F.lit("")).alias("text"), "time")
    counted = running_sum(said.unionByName(first), "turn", F.col("new"), F.floor(F.col(AT) / SPAN), AT)
    return counted.filter("new = 0").select(KEY, AT, "turn", "text", "time")


_ANOMALY = ("turn", "step", "time", "seq", "frame_index", "frame_start", "detail", "data")


def _anomaly(frame: DataFrame, kind: Column, at: Column, **given: Column) -> DataFrame:
    columns = {c: F.col(c) for c in ("time", "seq", "frame_index", "frame_start")} | {c: F.lit(None) for c in ("turn", "step", "data")} | given
    types = {"detail": "string", "data": "string"}
    return frame.select(KEY, at.cast("long").alias(AT), F.col(AT).alias("order_index"), kind.alias("kind"), *[columns[c].cast(types.get(c, "long")).alias(c) for c in _ANOMALY])


def announced(records: DataFrame) -> DataFrame:
    """Anomalies that a record tells by itself, in one pass over those types."""
    t, kind = F.col("type"), F.lit(None).cast("string")
    state = F.when(F.col("arguments_state") == "invalid", " arguments were not valid JSON").otherwise(" arguments were not an object")
    cases = [
        ("turn/end", "turn-aborted", (F.col("end_reason") != "") & (F.col("end_reason") != "completed"), F.concat(F.lit("turn "), _or_zero("turn"), F.lit(" ended with "), F.col("end_reason"))),
        ("tool/call", "tool-error", F.col("arguments_state") != "ok", F.concat(F.lit("tool call "), F.coalesce("detail", F.lit("undefined")), state)),
        ("approval/asked", "approval-asked", F.lit(True), F.col("detail")),
        ("approval/decided", "approval-denied", F.col("outcome").startswith("denied") | (F.col("outcome") == "rejected"), F.concat(F.lit("approval "), F.col("outcome"))),
        ("command/run", "permission-change", F.col("name") == "permission", F.col("detail")),
        ("compaction/start", "compaction", F.lit(True), F.col("detail")),
        ("llm/retry", "llm-retry", F.lit(True), F.col("detail")),
    ]
    detail = F.lit(None).cast("string")
    for type_, name, test, text in cases:
        kind, detail = F.when((t == type_) & test, name).otherwise(kind), F.when(t == type_, text).otherwise(detail)
    found = of_type(records, *[c[0] for c in cases]).withColumn("_kind", kind).filter("_kind is not null")
    turn = F.when(t == "turn/end", _or_zero("turn")).when(t.isin("approval/asked", "compaction/start", "llm/retry"), F.col("turn"))
    return _anomaly(found, F.col("_kind"), F.col(AT), turn=turn, step=F.when(t == "llm/retry", F.col("step")), detail=detail, data=F.when(t.isin("turn/end", "tool/call"), F.lit(None)).otherwise(F.col("data")))


def anomalies(records: DataFrame) -> DataFrame:
    """All anomalies: kind, turn, step, time, seq, detail, data (JSON), and the record they came with."""

    def named(*pairs: tuple[str, Column]) -> Column:
        parts = [F.concat(F.lit(f'"{k}":'), _json_string(v)) for k, v in pairs]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    orphan = F.col("call_at").isNull()
    bad = results(records).filter(orphan | F.col("is_error"))
    failed = F.concat(F.col("call_name"), F.lit(" failed: "), F.substring("text", 1, 160))
    from_results = _anomaly(
        bad, F.when(orphan, "orphan-tool-result").otherwise("tool-error"), F.col(AT), turn=F.when(~orphan, F.col("call_turn")), step=F.when(~orphan, F.col("call_step")),
        detail=F.when(orphan, F.concat(F.lit("result for unknown call "), F.col("call_id"))).otherwise(failed), data=F.when(~orphan, named(("callId", F.col("call_id")), ("tool", F.col("call_name")))),
    )
    lonely = unpaired_calls(calls(records))
    unpaired = _anomaly(lonely, F.lit("unpaired-tool-call"), F.lit(-1), turn=F.col("turn"), step=F.col("step"), detail=F.concat(F.lit("no result recorded for "), F.col("name")), data=named(("callId", F.col("call_id"))))
    return announced(records).unionByName(from_results).unionByName(unpaired)


def _json_string(text: Column) -> Column:
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def in_log_order(frame: DataFrame, *more: str) -> DataFrame:
    """Sorted by seq, or time where there is no seq, then by place."""
    return frame.orderBy(KEY, F.coalesce("seq", "time", F.lit(0)), *(more or (AT,)))
