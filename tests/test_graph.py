"""The session graph, effects and chains against a plain model of the rules, on random logs and by hand."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.ledger import Ledger
from auditloom.operators import graph
from auditloom.operators.chains import version_chains
from auditloom.operators.records import narrow, prefix_metadata, typed


def ledger(spark, sessions, parts=3):
    rows = [(key, i, i, i * 100, json.dumps(r) if not isinstance(r, str) else r) for key, records in sessions.items() for i, r in enumerate(records)]
    lines = spark.createDataFrame(rows, "session_key string, record_index long, frame_index long, frame_start long, line string").repartition(parts)
    return Ledger(typed(lines).persist())


def rec(kind, i, time=None, **data):
    return {"type": kind, "seq": i, "time": 1000 + 10 * i if time is None else time, "data": data}


def call(i, cid, name="bash", args=None, turn=1, step=1, **more):
    return rec("tool/call", i, turn=turn, step=step, callId=cid, name=name, arguments=json.dumps(args if args is not None else {}), **more)


def result(i, cid, error=False, text="ok", time=None):
    return rec("tool/result", i, time, message={"source": {"callId": cid}, "content": [{"type": "r", "isError": error, "content": [{"type": "text", "text": text}, {"type": "image"}]}]})


def message(i, mid, turn=1, model="m", usage=5):
    return rec("assistant/message", i, turn=turn, step=1, message={"id": mid, "source": {"model": model}, "content": [{"type": "text", "text": "hi"}, {"type": "x"}]}, **({"usage": {"inputTokens": usage, "outputTokens": 1}} if usage else {}))


HEAD = {"type": "session", "version": 1, "id": "s-1", "createdAt": 900, "cwd": "C:\\proj", "agentPreset": "p"}


def test_one_turn(spark):
    records = [
        HEAD, rec("turn/start", 1, 1000, turn=1), rec("step/start", 2, 1000, turn=1, step=1), message(3, "m1"), call(4, "c1", "read", {"file_path": "a.txt"}), result(5, "c1", True, "boom", 1090),
        rec("llm/retry", 6, turn=1, step=1, retry=1, maxRetries=3, failure={"code": "overloaded", "message": "x"}, retryId="r", delayMs=5), message(7, "m1"), rec("step/end", 8, 1100, turn=1, step=1),
        rec("turn/end", 9, 1120, turn=1, reason={"kind": "completed"}), {"type": "text-chunks", "data": {"texts": ["ab", "😀"], "text": "c"}}, "[1]", '{"type":""}',
    ]
    led = ledger(spark, {"x": records})
    t, s = led.turns.first(), led.steps.first()
    assert (t.duration_ms, t.errors, t.n_calls, t.unterminated, t.end_reason, t.input_tokens, t.messages) == (120, 1, 1, False, "completed", 5, 1)
    assert (s.duration_ms, s.n_calls, s.unterminated) == (100, 1, False)
    c = led.calls.first()
    assert (c.duration_ms, c.result.is_error, c.result.text_bytes, c.path, c.kind) == (50, True, 4, "C:\\proj\\a.txt", "read")
    a = {r.kind: r for r in led.anomalies.collect()}
    assert set(a) == {"tool-error", "llm-retry"} and a["tool-error"].detail == "read failed: boom" and a["llm-retry"].detail == "retry 1/3 after overloaded"
    assert json.loads(a["tool-error"].data) == {"callId": "c1", "tool": "read"} and json.loads(a["llm-retry"].data)["delayMs"] == 5
    st = led.stats.first()
    assert (st.records, st.parsed, st.unparsable, st.streaming_records, st.reasoning_chars, st.tool_calls, st.tool_results) == (13, 11, 2, 1, 5, 1, 1)
    assert led.assistant_texts.count() == 1 and led.assistant_texts.first().block_pos == 0


def test_duplicates_orphans_and_order(spark):
    records = [
        result(0, "late"), call(1, "late"), call(2, "dup", "write", {"path": "x", "content": "é"}), result(3, "dup", True), result(4, "dup"), call(5, "dup", "grep"), result(6, "ghost"), message(7, "m", usage=10), message(8, "m", usage=99),
        message(9, None, 2, "n", 0), rec("user/message", 10, content=[{"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "image"}]), rec("turn/end", 11, turn=3, reason={"kind": "aborted"}),
        rec("approval/decided", 12, outcome="denied-x", id=4), rec("approval/asked", 13, toolName="rm", turn=1, id=4, callId="c", reason="r"), rec("command/run", 14, name="permission", args=" auto ", commandId="k"),
        rec("compaction/start", 15, compactionId="z"), rec("tool/call", 16, callId=7, arguments="nope"), rec("tool/call", 17, callId="q", name="bash", arguments="5"), rec("step/end", 18, turn=9, step=9),
    ]
    led = ledger(spark, {"x": records})
    calls = {r.record_index: r for r in led.calls.collect()}
    assert calls[2].result.is_error is False and calls[5].result is None and calls[1].result is None and calls[16].call_id == "" and calls[16].name == "(unknown)"
    kinds = sorted((r.kind, r.record_index) for r in led.anomalies.collect())
    assert kinds == sorted([("orphan-tool-result", 0), ("orphan-tool-result", 6), ("tool-error", 3), ("turn-aborted", 11), ("approval-denied", 12), ("approval-asked", 13), ("permission-change", 14), ("compaction", 15), ("tool-error", 16), ("tool-error", 17)] + [("unpaired-tool-call", -1)] * 4)
    details = {r.record_index: r.detail for r in led.anomalies.collect()}
    assert details[16] == "tool call undefined arguments were not valid JSON" and details[17] == "tool call bash arguments were not an object" and details[14] == "permission preset changed to auto" and details[15] == "context compaction started in turn ?"
    usage = {(r.turn, r.model): (r.input_tokens, r.messages) for r in led.usage.collect()}
    assert usage[(None, None)] == (10, 1) and usage[(2, None)] == (0, 0) and usage[(None, "n")] == (0, 0) and usage[(1, None)] == (10, 1)
    assert (led.user_messages.first().turn, led.user_messages.first().text) == (2, "ab")
    assert {r.turn for r in led.turns.collect()} == {0, 1, 2, 3} and led.steps.count() == 0


def test_working_directory_so_far_and_governance(spark):
    read = lambda i: call(i, f"c{i}", "read", {"file_path": "f"})
    records = [read(0), HEAD | {"cwd": "/one"}, read(2), HEAD | {"cwd": None, "id": "s-2"}, read(4), rec("sandbox/mode", 5, mode=""), rec("sandbox/mode", 6, mode="a"), rec("sandbox/mode", 7, mode="b"), rec("approval/policy", 8, policy=3)]
    led = ledger(spark, {"x": records, "y": [read(0)]})
    assert {(r.session_key, r.record_index): r.path for r in led.calls.collect()} == {("x", 0): "f", ("x", 2): "/one\\f", ("x", 4): "f", ("y", 0): "f"}
    s = led.sessions.filter("session_key = 'x'").first()
    assert (s.session_id, s.cwd, s.sandbox_mode, s.sandbox_mode_final, s.approval_policy) == ("s-2", None, "a", "b", None)


def test_effects_of_every_group(spark):
    cases = [
        ("write", {"file_path": " \"a/b.txt\" ", "content": "héé"}, ("write", "exact", "C:\\proj\\a\\b.txt", 5, None, "wrote 5 bytes", False)),
        ("edit", {"path": "/x/y", "old_string": "é", "newText": "abc", "replaceAll": True}, ("edit", "partial", "\\x\\y", 3, None, "replaced 2 bytes with 3 (all occurrences)", False)),
        ("read", {"filePath": "D:/q"}, ("read", "observed", "D:\\q", None, None, "read the file", False)),
        ("read_image", {"path": "\\\\srv\\s/t", "offset": 3}, ("read", "observed", "\\\\srv\\s\\t", None, None, "read a window (offset 3, limit end)", False)),
        ("read", {"path": "p", "limit": 2.0}, ("read", "observed", "C:\\proj\\p", None, None, "read a window (offset 0, limit 2)", False)),
        ("write", {"file_path": ""}, ("unknown", "opaque", None, None, None, "write without a path", True)),
        ("grep", {"pattern": "a\"b\n", "include": "*.py"}, ("search", "observed", "C:\\proj", None, "a\"b\n", "searched for \"a\\\"b\\n\" in *.py", False)),
        ("shell", {"command": "ls " + "x" * 100}, ("shell", "undecidable", None, None, "ls " + "x" * 100, "ran ls " + "x" * 77, True)),
        ("bash", {"command": "ls", "description": "look"}, ("shell", "undecidable", None, None, "ls", "look", True)),
        ("web_fetch", {"url": "http://h"}, ("network", "observed", None, None, "http://h", "queried \"http://h\"", False)),
        ("workflow", {}, ("delegation", "observed", None, None, "workflow", "delegated work via workflow", False)),
        ("job_kill", {"job_id": "j"}, ("control", "observed", None, None, "j", "called job_kill", False)),
        ("mystery", {"b": 1, "a": [1.0, None, "é"]}, ("unknown", "opaque", None, None, '{"b":1,"a":[1,null,"é"]}', "unrecognised tool mystery", True)),
    ]
    led = ledger(spark, {"x": [HEAD] + [call(i + 1, f"c{i}", name, args) for i, (name, args, _) in enumerate(cases)]})
    got = {r.call_id: (r.kind, r.fidelity, r.path, r.bytes, r.source, r.detail, r.undecidable) for r in led.effects.collect()}
    for i, (_, _, want) in enumerate(cases):
        assert got[f"c{i}"] == want
    assert led.effect_summary.count() == 9


def test_version_chains(spark):
    steps = [("write", "new"), ("edit", "old"), ("bash", None), ("edit", "new"), ("write", "clean"), ("read", "clean"), ("read", "old"), ("write", "new")]
    calls = [call(i + 1, f"c{i}", n, {"command": "ls"} if p is None else {"path": p, "content": f"v{i}", "new_string": "z"}) for i, (n, p) in enumerate(steps)]
    led = ledger(spark, {"x": [HEAD, *calls]})
    got = {r.path.split("\\")[-1]: r for r in led.chains.collect()}
    assert (got["new"].created, got["new"].contaminated, got["new"].shells_in_window, got["new"].steps) == (True, True, 1, 3)
    assert (got["old"].preexisting, got["old"].contaminated) == (True, True) and (got["clean"].created, got["clean"].contaminated) == (True, False)
    assert got["new"].last_exact_hash == __import__("hashlib").sha256(b"v7").hexdigest()
    assert [r.position for r in led.chain_steps.filter("path like '%new'").orderBy("position").collect()] == [1, 2, 3]


def test_shell_counts_over_many_buckets(spark):
    rng = random.Random(5)
    rows = [("x", i, rng.choice([None, rng.randint(0, 50_000)]), rng.choice(["shell", "read", "write"]), f"p{rng.randint(0, 30)}") for i in range(3000)]
    effects = spark.createDataFrame([(k, i, s, i, kind, None if kind == "shell" else p, "exact", "h") for k, i, s, kind, p in rows], "session_key string, record_index long, seq long, time long, kind string, path string, fidelity string, content_hash string")
    shells = [s for _, _, s, kind, _ in rows if kind == "shell" and s is not None]
    seqs = defaultdict(list)
    for _, _, s, kind, p in rows:
        if kind != "shell" and s is not None:
            seqs[p].append(s)
    for r in version_chains(effects).collect():
        own = seqs[r.path]
        assert r.shells_in_window == (sum(min(own) <= s <= max(own) for s in shells) if own else 0)


def model(records):
    """Pairing, errors and usage by the rules, one record after the other."""
    calls, latest, orphans, errors, seen, usage = [], {}, 0, defaultdict(int), set(), 0
    for r in records:
        d = r["data"]
        if r["type"] == "tool/call":
            latest[d["callId"]] = len(calls)
            calls.append([d["turn"], None, r["time"], None])
        elif r["type"] == "tool/result":
            cid = d["message"]["source"]["callId"]
            if cid not in latest:
                orphans += 1
                continue
            c = calls[latest[cid]]
            c[1] = d["message"]["content"][0]["isError"]
            if r["time"] and c[2]:
                c[3] = r["time"] - c[2]
            errors[c[0]] += c[1]
        elif r["type"] == "assistant/message":
            mid = d["message"]["id"]
            if mid not in seen:
                seen.add(mid)
                usage += d["usage"]["inputTokens"]
    return [(c[1], c[3]) for c in calls], orphans, {t: n for t, n in errors.items() if n}, usage


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_random_logs_equal_the_model(spark, parts):
    rng, sessions = random.Random(parts), {}
    for key in ("a", "b", "c"):
        records = []
        for i in range(120):
            cid, turn = f"c{rng.randint(0, 25)}", rng.randint(1, 4)
            records.append(rng.choice([call(i, cid, turn=turn), result(i, cid, rng.random() < 0.3, time=rng.choice([0, 1000 + i])), message(i, f"m{rng.randint(0, 20)}", turn, usage=rng.randint(1, 9))]))
        sessions[key] = records
    led = ledger(spark, sessions, parts)
    for key, records in sessions.items():
        mine = f"session_key = '{key}'"
        calls, orphans, errors, usage = model(records)
        got = led.calls.filter(mine).orderBy("record_index").collect()
        assert [(r.result.is_error if r.result else None, r.duration_ms) for r in got] == calls
        assert led.results.filter(mine).filter("call_at is null").count() == orphans
        assert {r.turn: r.errors for r in graph.turn_errors(led.records).filter(mine).collect()} == errors
        assert graph.usage(led.messages).filter(mine).first().input_tokens == usage


def test_prefix_metadata(spark):
    lines = ['{"type":"a/b","seq":12,"x":1}', '{"type":"c","seq0":7}', '{"type":"session","version":1,"id":"s-9"}', '{"seq":1,"type":"z"}', '{"type":"d","data":{"seq":4}}']
    got = [tuple(r)[1:] for r in prefix_metadata(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("a/b", 12, None), ("c", 7, None), ("session", None, "s-9"), (None, None, None), ("d", None, None)]


def test_narrowing_never_converts():
    assert narrow({"type": 5}) == {"valid": False} and narrow([1]) == {"valid": False}
    r = narrow({"type": "turn/start", "seq": "5", "seq0": 6, "time": True, "time0": 7.0, "data": {"turn": "1"}})
    assert (r["seq"], r["time"], r["turn"]) == (6, 7, None)


def test_sums_over_stretches_equal_those_over_sessions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, -7, 0, rng.randint(-50, 400)]), i, rng.randint(0, 3)) for i in range(500)]
    frame = spark.createDataFrame(rows, "session_key string, ts long, o long, v long")
    got = graph.running_sum(frame, "n", F.col("v"), F.floor(F.col("ts") / 10), "ts", "o").collect()
    want, sums = {}, {}
    for k, ts, o, v in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want[o] = sums[k] = sums.get(k, 0) + v
    assert {r.o: r.n for r in got} == want and len(got) == 500 and got[0].asDict().keys() == {"session_key", "ts", "o", "v", "n"}
