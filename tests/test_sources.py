import os
import time

import pytest

from auditloom import read_ledger, read_lines, records_of, tail
from auditloom.sources.discover import find_session_logs, resolve_log
from auditloom.sources.sessionlog import LogPart, Options, _batches, complete_until, packed
from auditloom.streaming.pairing import calls_by_window, pair_stream
from auditloom.streaming.sinks import once_per_line, to_parquet
from auditloom.testing import frame, log, session_records


def write(path, data, mode="wb"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(data)
    return str(path)


def home(tmp_path):
    for i, name in enumerate(("aaa-1", "bbb-2", "bbc-3")):
        p = tmp_path / "sessions" / f"proj{i % 2}" / name / "session.jsonl.zstd"
        write(p, log(session_records(2, 1, session=name)))
        os.utime(p, (1000 + i, 1000 + i))
    write(tmp_path / "sessions" / "proj0" / "notes.txt", b"x")
    return str(tmp_path)


def test_discovery_and_resolution(spark, tmp_path):
    folder = home(tmp_path)
    got = find_session_logs(spark, folder).collect()
    assert [(r.session_id, r.project, r.modified_at) for r in got] == [("bbc-3", "proj0", 1002000), ("bbb-2", "proj1", 1001000), ("aaa-1", "proj0", 1000000)]
    assert find_session_logs(spark, folder + "/nothing").count() == 0
    assert resolve_log(spark, "aaa", folder) == got[2].path == resolve_log(spark, got[2].path, folder)
    for bad in ("bb", "zzz"):
        with pytest.raises(LookupError):
            resolve_log(spark, bad, folder)


def test_batch_of_many_logs(spark, tmp_path):
    lines = read_lines(spark, home(tmp_path))
    assert lines.filter("row_kind = 'line'").count() == 3 * len(session_records(2, 1))
    ledger = read_ledger(spark, str(tmp_path))
    assert ledger.sessions.count() == 3 and ledger.calls.count() == 6 and ledger.diagnostics.count() == 0
    ledger.register_views("v_")
    assert spark.sql("select count(distinct session_key) n from v_turns").first().n == 3


def run(stream, out, checkpoint):
    query = to_parquet(stream, out, checkpoint)
    query.awaitTermination()


def test_stream_follows_appends_and_equals_batch(spark, tmp_path):
    records = session_records(3, 2)
    path = write(tmp_path / "in" / "session.jsonl.zstd", log(records[:10]))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run(tail(spark, str(tmp_path / "in")), out, mark)
    assert spark.read.parquet(out).count() == 10
    extra = log(records[10:])
    write(tmp_path / "in" / "session.jsonl.zstd", extra[:-7], "ab")
    run(tail(spark, str(tmp_path / "in")), out, mark)
    assert spark.read.parquet(out).count() == len(records) - 1
    write(tmp_path / "in" / "session.jsonl.zstd", extra[-7:], "ab")
    write(tmp_path / "in" / "other" / "session.jsonl.zstd", log(records[:4]))
    run(tail(spark, str(tmp_path / "in")), out, mark)
    run(tail(spark, str(tmp_path / "in")), out, mark)
    got = spark.read.parquet(out)
    assert once_per_line(got).count() == got.count() == len(records) + 4
    batch = read_lines(spark, path)
    key = ["path", "frame_index", "frame_start", "line_no", "line"]
    assert got.filter(f"path = '{path}'").select(key).exceptAll(batch.select(key)).count() == 0


def test_stream_over_a_line_in_two_frames_and_garbage(spark, tmp_path):
    head = frame({"type": "a"}) + frame(text='{"type":"b"}\n{"ty')
    write(tmp_path / "in" / "session.jsonl.zstd", head)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run(tail(spark, str(tmp_path / "in")), out, mark)
    assert spark.read.parquet(out).count() == 1
    write(tmp_path / "in" / "session.jsonl.zstd", frame(text='pe":"c"}\n') + b"garbage!" + frame({"type": "d"}), "ab")
    run(tail(spark, str(tmp_path / "in")), out, mark)
    got = spark.read.parquet(out)
    assert sorted(r.line for r in got.filter("row_kind = 'line'").collect()) == ['{"type":"%s"}' % x for x in "abcd"]
    assert got.filter("kind = 'corrupt'").first().skipped_bytes == 8


def test_live_pairing(spark, tmp_path):
    call = lambda i, n: {"type": "tool/call", "seq": i, "time": 1000 + i, "data": {"turn": 1, "step": 1, "callId": n, "name": "bash", "arguments": "{}"}}
    result = lambda i, n: {"type": "tool/result", "seq": i, "time": 1000 + i, "data": {"message": {"source": {"callId": n}, "content": []}}}
    write(tmp_path / "in" / "session.jsonl.zstd", log([call(1, "a"), call(2, "b"), result(3, "ghost")]))
    records = records_of(tail(spark, str(tmp_path / "in")))
    query = pair_stream(records, 8000).writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "m")).trigger(processingTime="200 milliseconds").start()
    # processAllAvailable() would wait for ever: with timeouts there is always another batch to come.
    try:
        until = time.time() + 40
        while time.time() < until and spark.table("pairs").count() < 1:
            time.sleep(0.2)
        write(tmp_path / "in" / "session.jsonl.zstd", log([result(9, "a")]), "ab")
        until = time.time() + 40
        while time.time() < until and spark.table("pairs").count() < 3:
            time.sleep(0.3)
    finally:
        query.stop()
    got = {r.call_id: r for r in spark.table("pairs").collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "paired", "b": "unpaired", "ghost": "orphan"}
    assert got["a"].duration_ms == 8 and got["a"].name == "bash"


def test_windows(spark, tmp_path):
    write(tmp_path / "session.jsonl.zstd", log(session_records(4, 3)))
    records = records_of(read_lines(spark, str(tmp_path)))
    assert sum(r.calls for r in calls_by_window(records).collect()) == 12


def test_small_logs_share_tasks(spark, tmp_path):
    parts = packed([(LogPart(str(i)), 100) for i in range(1000)], 64 << 20, 10)
    assert [p.path for t in parts for p in t.parts] == [str(i) for i in range(1000)] and 10 <= len(parts) <= 17
    assert len(packed([(LogPart(str(i)), 100) for i in range(5)], 64 << 20, 200)) == 5 and packed([], 1, 1) == []
    assert [len(t.parts) for t in packed([(LogPart("a"), 1 << 30), (LogPart("b"), 0), (LogPart("c"), 0)], 64 << 20, 1)] == [1, 2]
    for i in range(12):
        write(tmp_path / str(i) / "session.jsonl.zstd", log(session_records(2, 1)))
    lines = read_lines(spark, str(tmp_path), tasks=3)
    assert lines.rdd.getNumPartitions() == 3 and lines.groupBy("path").count().count() == 12


def test_many_small_logs_are_few_tasks_and_batches(tmp_path):
    """The tasks of 100,000 small logs are those that were asked for, and a batch reaches over its task's logs."""
    assert 200 <= len(packed([(LogPart(str(i)), 4096) for i in range(100_000)], 64 << 20, 200)) <= 210
    paths = [write(tmp_path / str(i) / "session.jsonl.zstd", log(session_records(2, 1))) for i in range(5)]
    (batch,) = _batches([LogPart(p) for p in paths], Options({}), dense=True)
    each = [b for p in paths for b in _batches([LogPart(p)], Options({}), dense=True)]
    assert batch.to_pylist() == [row for b in each for row in b.to_pylist()] and {r["path"] for r in batch.to_pylist()} == set(paths)


def test_offsets_of_logs_longer_than_what_is_read_at_once(tmp_path):
    data = log(session_records(30, 4)) + b"?" * 9 + frame(text='{"type":"a"}\n{"half')
    path = write(tmp_path / "session.jsonl.zstd", data)
    for chunk in (50, 333, 1 << 20):
        got = complete_until(path, 0, 0, Options({"path": path, "chunkBytes": str(chunk), "readAheadChunks": "1"}))
        assert got == (len(data) - len(frame(text='{"type":"a"}\n{"half')), len(session_records(30, 4)))
