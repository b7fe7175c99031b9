import hashlib
import io
import os

from auditloom.sources.tail import Follower, Tail, strict_rows
from auditloom.testing import frame, log, skippable


def drain(data, step=1 << 20, tail=None):
    tail = tail or Tail()
    rows = [r for i in range(0, len(data), step) for r in tail.feed(data[i : i + step])]
    return tail, [r for r in rows if r["row_kind"] == "line"], [r for r in rows if r["row_kind"] == "diagnostic"]


def records(n, start=0):
    return [{"type": "x", "i": i} for i in range(start, start + n)]


def test_provenance_of_fifty_frames():
    data = log(records(50))
    tail, lines, problems = drain(data)
    assert [r["frame_index"] for r in lines] == list(range(50)) and not problems
    assert all(data[r["frame_start"] : r["frame_start"] + 4] == b"\x28\xb5\x2f\xfd" for r in lines)
    assert tail.checkpoint == (len(data), 50) and tail.pending == 0


def test_tiny_chunks_and_bounded_memory():
    assert len(drain(log(records(30)), step=17)[1]) == 30
    tail, most = Tail(), 0
    data = log(records(4000))
    for i in range(0, len(data), 4096):
        list(tail.feed(data[i : i + 4096]))
        most = max(most, tail.pending)
    assert tail.records == 4000 and most < 64 << 10


def test_half_written_tail_is_read_once():
    data = log(records(3))
    tail, lines, problems = drain(data[:-12])
    assert len(lines) == 2 and tail.checkpoint[1] == 2 and not problems
    assert len(list(tail.feed(data[-12:]))) == 1 and tail.checkpoint == (len(data), 3)


def test_restart_from_a_checkpoint():
    data = log(records(20))
    offset, number = drain(log(records(10)))[0].checkpoint
    tail, lines, _ = drain(data[offset:], tail=Tail(offset, number))
    assert [r["frame_index"] for r in lines] == list(range(10, 20)) and lines[0]["frame_start"] == offset


def test_garbage_between_frames():
    head = log(records(2))
    data = head + b"this is not a frame at all" + log(records(2, 2))
    for step in (1 << 20, 32, 5):
        tail, lines, problems = drain(data, step)
        assert len(lines) == 4 and {p["kind"] for p in problems} == {"corrupt"}
        assert problems[0]["frame_start"] == len(head) and sum(p["skipped_bytes"] for p in problems) == 26


def test_lines_over_frames_and_the_checkpoint():
    parts = [frame(text='{"type":"a"}\n{"ty'), frame(text='pe":"b"'), frame(text='}\n{"type":"c"}\n')]
    tail, lines, problems = drain(parts[0])
    assert tail.checkpoint == (0, 0)
    list(tail.feed(parts[1]))
    assert tail.checkpoint == (0, 0)
    assert [r["line"] for r in tail.feed(parts[2])] == ['{"type":"b"}', '{"type":"c"}'] and tail.checkpoint[1] == 3


def test_bad_json_skippable_and_oversize():
    data = frame(text="{bad}\n\n  \n[1]\n") + skippable(b"zzz") + frame({"type": "y"})
    tail, lines, problems = drain(data)
    assert [r["line"] for r in lines] == ["[1]", '{"type":"y"}'] and problems[0]["kind"] == "bad-json"
    big = frame({"t": os.urandom(9000).hex()})
    tail, lines, problems = drain(big[:-5] + frame({"type": "y"}), step=64, tail=Tail(most_frame_bytes=512))
    assert "oversize-frame" in {p["kind"] for p in problems} and lines[-1]["line"] == '{"type":"y"}'


def test_broken_payload_keeps_alignment():
    broken = bytearray(frame({"type": "a", "x": "hello" * 30}))
    broken[-3] ^= 0x55
    tail, lines, problems = drain(bytes(broken) + frame({"type": "b"}))
    assert lines[-1]["line"] == '{"type":"b"}' and (len(lines) == 1) == bool(problems)


def test_strict_rows_stop_and_hash():
    data = frame(text='{"type":"a"}\n{"half') + frame(text='":1}\n')
    rows = list(strict_rows(data + b"junk" + frame({"z": 1})))
    assert [r["row_kind"] for r in rows] == ["frame", "line", "line", "frame", "line", "diagnostic"]
    assert rows[0]["leaf"] == hashlib.sha256(b"\0" + data[: rows[0]["frame_end"]]).digest()
    assert rows[1]["leaf"] == hashlib.sha256(b'\0{"type":"a"}').digest() and rows[2]["valid"] is False


def test_strict_rows_in_chunks_equal_those_of_the_whole():
    whole = log(records(40)) + skippable(b"q" * 50) + frame({"t": os.urandom(3000).hex()}) + log(records(3))
    for data in (whole, whole[:-4], whole + b"no frame at all" * 30, whole[:200] + b"junk" + whole, b"", b"ab", b"abcd"):
        want = list(strict_rows(data))
        for chunk in (1, 7, 64, 1000):
            assert list(strict_rows(io.BytesIO(data), chunk=chunk)) == want
        assert list(strict_rows(io.BytesIO(data), 150, 16)) == list(strict_rows(data[:150]))
    assert want[0]["skipped_bytes"] == 4 and sum(r["row_kind"] == "frame" for r in strict_rows(whole)) == 45


def test_a_follower_polls_rewinds_and_counts(tmp_path):
    path, first, more = tmp_path / "log", log(records(6)), log(records(4, 6))
    path.write_bytes(first + more[:-3])
    with Follower(str(path), chunk=64, ahead=2) as follower:
        rows = []
        while not follower.at_end:
            rows += follower.poll()
        assert [r["frame_index"] for r in rows] == list(range(9)) and follower.poll() == []
        stats = follower.stats
        assert stats["frames"] == stats["records"] == 9 and 0 < stats["pending_bytes"] < len(more) and stats["diagnostics"] == []
        path.write_bytes(first + more + b"junk, more junk")
        follower.close()
        assert [r["row_kind"] for r in follower.poll()] == ["line", "diagnostic"]
        while not follower.at_end:
            follower.poll()
        assert follower.stats["bytes_read"] == path.stat().st_size and [d["kind"] for d in follower.stats["diagnostics"]] == ["corrupt"]
        offset, number = len(first), 6
        follower.rewind(offset, number)
        assert follower.stats["frames"] == 0 and follower.stats["checkpoint"] == (offset, number) and follower.stats["diagnostics"] == []
        while not follower.at_end:
            follower.poll()
        assert follower.stats["frames"] == follower.stats["records"] == 4
    assert follower.file is None
