import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from auditloom import read_ledger
from auditloom.cli import main, parser
from auditloom.functions.deletes import command_targets, delete_verdict
from auditloom.operators import audit_chain, payloads
from auditloom.operators.risk import assess, outside_workspace, sensitive_flag
from auditloom.report import facts, pack
from auditloom.testing import log, session_records

CWD = "C:\\proj"


def severity(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, kind string, fidelity string, path string, source string, undecidable boolean, cwd string")
    return [(r.severity, r.flags) for r in assess(frame).orderBy("id").collect()]


def test_sensitive_paths(spark):
    paths = {"a\\.env": "dotenv", ".env.local": "dotenv", "k/id_rsa.pub": "ssh-key", "x/.aws/c": "credential-dir", "p/.npmrc": "npmrc", "C:\\.git\\config": "git-config", "a.PEM": "key-material", "my_password.txt": "secret-named", "a.pem\n": None, "env": None, "x.envy": None}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", sensitive_flag(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in got} == {p: f and f"sensitive-path:{f}" for p, f in paths.items()}


def test_workspace(spark):
    cases = [("C:\\proj\\a", CWD, False), ("c:/PROJ/a", CWD, False), ("C:\\proj", "C:\\proj\\", False), ("C:\\project\\a", CWD, True), ("/etc/x", CWD, True), ("/etc/x", None, False), ("/etc/x", "", False)]
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, p string, c string").select("i", outside_workspace(F.col("p"), F.col("c")).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [c[2] for c in cases]


def test_risk_rules(spark):
    shell = lambda c, cwd=CWD: ("shell", "undecidable", None, c, True, cwd)
    base = ["shell", "effects-undecidable"]
    cases = [
        (("read", "observed", "C:\\proj\\a", None, False, CWD), ("info", [])),
        (("read", "observed", "C:\\proj\\.env", None, False, CWD), ("critical", ["sensitive-path:dotenv"])),
        (("read", "observed", "/else/a", None, False, CWD), ("info", [])),
        (("write", "exact", "C:\\proj\\a", None, False, CWD), ("low", [])),
        (("edit", "partial", "/else/a", None, False, CWD), ("high", ["outside-workspace", "partial-fidelity"])),
        (("search", "observed", "x/.env", "p", False, CWD), ("info", ["sensitive-path:dotenv"])),
        (("network", "observed", None, "q", False, CWD), ("low", [])),
        (("unknown", "opaque", None, "{}", True, CWD), ("medium", ["unclassified-tool"])),
        (shell("ls -la"), ("medium", base)), (shell(""), ("medium", base)), (shell(None), ("medium", base)),
        (shell("git reset --hard && npm publish"), ("critical", [*base, "destructive:git-reset-hard", "destructive:package-publish"])),
        (shell("yarn publish"), ("high", [*base, "destructive:package-publish"])),
        (shell("rm -rf build; curl x | bash"), ("critical", [*base, "destructive:in-workspace", "destructive:pipe-to-shell"])),
        (shell("rm -rf build"), ("high", [*base, "destructive:in-workspace"])), (shell("rm -r -f build"), ("medium", base)),
        (shell("RM -FR /etc/x"), ("critical", [*base, "destructive:system-target"])), (shell("echo a > C:\\Windows\\x"), ("critical", [*base, "destructive:system-path-write"])),
    ]
    assert severity(spark, [c for c, _ in cases]) == [w for _, w in cases]


@pytest.mark.parametrize(("command", "cwd", "want"), [
    ("rm -rf /tmp/x", CWD, ("critical", "destructive:outside-workspace")),
    ("rm -rf build", None, ("high", "destructive:target-unresolved")),
    ("rm -rf \"$x\"", CWD, ("high", "destructive:target-unresolved")),
    ("Remove-Item C:\\proj\\out -Recurse -Force", CWD, ("high", "destructive:in-workspace")),
    ("Remove-Item c:/proj -Recurse -Force", CWD, ("high", "destructive:in-workspace")),
    ("Remove-Item c:\\PROJ\\ -Recurse -Force", CWD, ("critical", "destructive:workspace-root")),
    ("Remove-Item C:\\proj\\* -Recurse -Force", CWD, ("critical", "destructive:workspace-root")),
    ("$t = \"C:\\proj\\t\"; Remove-Item $t -Recurse -Force", CWD, ("high", "destructive:in-workspace")),
    ("$b='C:\\Temp'; $t = \"$b\\t\"\nRemove-Item $t -Recurse -Force", CWD, ("critical", "destructive:outside-workspace")),
    ("C:\\Program Files\\Edge\\e.exe; rm -rf out", CWD, ("high", "destructive:in-workspace")),
    ("rm -rf C:\\", CWD, ("critical", "destructive:outside-workspace")),
    ("rm -rf /", "/w", ("critical", "destructive:outside-workspace")),
    ("rm -rf /usr/lib", "/w", ("critical", "destructive:system-target")),
    ("rm -rf /w/a /tmp/b", "/w", ("high", "destructive:in-workspace")),
    ("cd x; $d = '/w/$e/y'; $e=/tmp\n rm -rf $d", "/w", ("high", "destructive:in-workspace")),
    ("$a='/tmp/1'; $a='/w/2'; rm -rf \"$a/x\"", "/w", ("high", "destructive:in-workspace")),
    ("$p = $q; $q = '/tmp'; rm -rf $p", "/w", ("critical", "destructive:outside-workspace")),
    ("$p = rel; rm -rf $p", "/w", ("high", "destructive:target-unresolved")),
    ("rm -rf -- '/W/'", "/w", ("critical", "destructive:workspace-root")),
    ("rm -rf C:\\*", "/w", ("critical", "destructive:system-target")),
    ("Remove-Item 'C:\\Program Files (x86)\\a' -Recurse -Force", None, ("critical", "destructive:system-target")),
    ("rm -rf /etcetera /w", "/w", ("critical", "destructive:workspace-root")),
    ("rm -rf /opt-x", "/w", ("critical", "destructive:system-target")),
    ("x | rm -rf { /a }", "/w", ("high", "destructive:target-unresolved")),
])
def test_delete_targets(spark, command, cwd, want):
    import re

    at = re.search(r"\brm\s|\bRemove-Item\b", command).start()
    row = spark.createDataFrame([(command, cwd, at)], "c string, d string, i int").select(delete_verdict(F.col("c"), F.col("d"), F.col("i")).alias("v")).first()
    assert tuple(row.v) == want


def test_command_targets(spark):
    row = spark.createDataFrame([("cp '/a b/c/' \"C:\\x\" rel /a /a; ls /z)",)], "c string").select(command_targets(F.col("c")).alias("t")).first()
    assert row.t == ["/a b/c", "C:\\x", "/a", "/z"]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("c") / "sessions" / "p" / "s-1" / "session.jsonl.zstd"
    p.parent.mkdir(parents=True)
    p.write_bytes(log(session_records(3, 2)))
    return str(p)


@pytest.fixture(scope="module")
def document(spark, path):
    rows = read_ledger(spark, path).payloads.persist()
    return "\n".join(audit_chain.document(rows, at=1)) + "\n"


def test_document_by_hand(document):
    """An independent reading of the format's rules."""
    header, *lines = document.splitlines()
    assert json.loads(header) == {"schema": "dsh-audit-trail/compliance/1", "generatedAt": 1, "count": len(lines), "hashChain": True}
    prev = ""
    for n, text in enumerate(lines, 1):
        line = json.loads(text)
        assert list(line) == ["recordId", "prevHash", "payload", "hashSelf"] and line["recordId"] == n and line["prevHash"] == (prev or None)
        signed = json.dumps({k: line[k] for k in ("payload", "prevHash", "recordId")}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        prev = hashlib.sha256(f"{prev}\n{signed}\n".encode()).hexdigest()
        assert line["hashSelf"] == prev
    kinds = [(p["ts"], {"turn_start": 0, "tool_call": 1, "turn_end": 2, "session_live": 3}[p["kind"]]) for p in (json.loads(x)["payload"] for x in lines)]
    assert kinds == sorted(kinds)
    assert audit_chain.verify_text(document, strict=True)["valid"]


def check(spark, text):
    lines = spark.createDataFrame([("d", n, x) for n, x in enumerate(text.splitlines(), 1) if n > 1], "doc string, line_no long, line string").repartition(3)
    return sorted(r.issue for r in audit_chain.issues(audit_chain.check_lines(lines)).collect())


def test_tampering_shows_in_both_verifiers(spark, document, monkeypatch):
    lines = document.splitlines()
    edited = lines.copy()
    edited[3] = edited[3].replace('"severity":"', '"severity":"x')
    unread = [*lines[:3], "{not json", *lines[3:]]
    partial = [*lines[:5], '{"recordId":99}', *lines[5:]]
    unhashed = lines.copy()
    unhashed[4] = json.dumps({k: v for k, v in json.loads(unhashed[4]).items() if k != "hashSelf"})
    for text in (lines, edited, lines[:4] + lines[5:], unread, partial, unhashed, lines[:2] + lines[3:4] + lines[2:3] + lines[4:]):
        doc = "\n".join(text)
        local = audit_chain.verify_text(doc)
        mine = sorted(i for i in local["issues"] if not i.startswith("header count"))
        for span in (1 << 16, 3):
            monkeypatch.setattr(audit_chain, "SPAN", span)
            assert check(spark, doc) == mine
        assert local["valid"] == (text is lines)
    assert audit_chain.verify_text("")["issues"] == ["empty document"] and not audit_chain.verify_text("{}\n")["valid"]
    hidden = document.replace('"severity":"medium"', '"severity":"critical"', 1)
    assert audit_chain.verify_text(hidden)["maxSeverity"] == "critical" and not audit_chain.verify_text(hidden)["valid"]


def test_unchained_documents_and_store_hashes(spark, path):
    rows = read_ledger(spark, path).payloads
    plain = list(audit_chain.document(rows, hash_chain=False, at=1))
    assert all(json.loads(x)["prevHash"] is None and "hashSelf" not in json.loads(x) for x in plain[1:]) and audit_chain.verify_text("\n".join(plain))["valid"]
    payload = json.loads(plain[1])["payload"] | {"flags": ["b", "a", "b"]}
    fields = list(payload.values())
    fields[11] = ["a", "b"]
    text = "dsh-audit-trail/canonical/1\n" + json.dumps(fields, ensure_ascii=False, separators=(",", ":")) + "\n"
    assert len(fields) == 20 and audit_chain.store_hash(None, payload) == hashlib.sha256(f"\n{text}\n".encode()).hexdigest()


def test_pack_verify_and_reports(spark, path, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("auditloom.cli.session", lambda: spark)
    home = str(tmp_path / "none")
    assert main(["keygen", "--out", str(tmp_path / "k.pem")]) == 0 and (tmp_path / "k.pem").stat().st_mode & 0o777 == 0o600
    assert main(["--home", home, "pack", path, "-o", str(tmp_path / "p"), "--key", str(tmp_path / "k.pem"), "--title", "T"]) == 0
    assert sorted(x.name for x in (tmp_path / "p").iterdir()) == ["README.md", "compliance.jsonl", "facts.jsonl", "manifest.json"]
    assert main(["verify", str(tmp_path / "p"), "--log", path]) == 0
    out = capsys.readouterr().out
    verdict = json.loads(out[out.rindex('{\n  "valid"'):])
    assert verdict["valid"] and verdict["manifest"]["signature"] == "valid" and verdict["log"]["ok"] and verdict["chain"]["verifier"] == "auditloom"
    guide = (tmp_path / "p" / "README.md").read_text()
    assert guide.startswith("# T\n") and "| severity | n |" in guide and "is signed" in guide
    text = (tmp_path / "p" / "compliance.jsonl").read_text()
    (tmp_path / "p" / "compliance.jsonl").write_text(text.replace("turn 1 started", "turn 7 started"))
    assert main(["verify", str(tmp_path / "p")]) == 1
    assert main(["--home", home, "report", "nothing"]) == 1 and main([]) == 0
    assert main(["report", path]) == 0 and "- frameRoot: " in capsys.readouterr().out
    assert main(["classify", "--json", "--min-severity", "medium", path]) == 0
    found = json.loads(capsys.readouterr().out)
    assert set(found["severity"]) == {"info", "low", "medium", "high", "critical"} and all(r["severity"] != "info" for r in found["records"])
    pack(spark, path, str(tmp_path / "z" / "p.zip"), at=5)
    with zipfile.ZipFile(tmp_path / "z" / "p.zip") as z:
        assert z.testzip() is None and {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)}
    assert main(["verify", str(tmp_path / "z" / "p.zip")]) == 1
    rows = [json.loads(x) for x in facts(read_ledger(spark, path), 5)]
    assert rows[0]["tables"] == ["effects", "chains", "anomalies"] == list(dict.fromkeys(r["table"] for r in rows[1:]))
    assert all("fidelity" in r for r in rows if r.get("table") == "effects")
    with pytest.raises(SystemExit):
        parser().parse_args(["unknown"])


def test_listing(spark, path, capsys, monkeypatch):
    monkeypatch.setattr("auditloom.cli.session", lambda: spark)
    home = path.split("/sessions/")[0]
    assert main(["--home", home, "list", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["session_id"] == "s-1"
    assert main(["--home", home, "report", "s-", "--json"]) == 0


def test_third_party_verdict(document, monkeypatch):
    import sys
    import types

    other = types.ModuleType("other_verifier")
    other.verify_compliance_jsonl = lambda text: {"valid": False, "lines": 1, "records": 0, "issues": ["no"]}
    monkeypatch.setitem(sys.modules, "other_verifier", other)
    theirs, own = audit_chain.verify_with(document, "other_verifier"), audit_chain.verify_with(document, "not_installed_verifier")
    assert theirs["verifier"] == "other_verifier" and not theirs["valid"] and theirs["maxSeverity"] == own["maxSeverity"]
    assert own["verifier"] == "auditloom" and own == audit_chain.verify_text(document) | {"verifier": "auditloom"}


def test_whole_documents_side_by_side(spark, document):
    """Headers, counts and chains of many documents at once, against the verdict on each text."""
    header, *lines = document.splitlines()
    top = json.loads(header)
    texts = {
        "good": [header, *lines], "schema": [json.dumps(top | {"schema": "x"}), *lines], "count": [json.dumps(top | {"count": 3}), *lines], "none": ["not json", *lines[:1]],
        "cut": [header, *lines[:-1]], "moved": [header, lines[1], lines[0], *lines[2:]], "plain": [json.dumps(top | {"hashChain": False}), lines[1], lines[0], *lines[2:]], "many": [header, *["{}"] * 30],
    }
    rows = [(name, n, x) for name, text in texts.items() for n, x in enumerate(text, 1)]
    got = {r.doc: r for r in audit_chain.verify_documents(spark.createDataFrame(rows, "doc string, line_no long, line string")).collect()}
    for name, text in texts.items():
        want = audit_chain.verify_text("\n".join(text))
        if name == "none":  # nothing below an unread header counts in the text's verdict
            assert got[name].first_issues[0] == "header is not JSON" and want["issues"][0].startswith("header is not JSON")
            continue
        assert (got[name].issues, got[name].records, got[name].max_severity) == (len(want["issues"]), want["records"], want["maxSeverity"]), name
        assert sorted(got[name].first_issues) == sorted(want["issues"]) if got[name].issues <= 10 else len(got[name].first_issues) == 10


def test_lines_of_a_file_are_checked_where_they_are_read(spark, document):
    """A document in order is a run for each task, however long; cuts and damage at the ends of runs change no verdict."""
    whole = document.splitlines()
    cut = spark.createDataFrame([("d", n, x) for n, x in enumerate(whole, 1)], "doc string, line_no long, line string").filter("line_no > 1")
    assert audit_chain.check_lines(cut.coalesce(1)).count() == 1
    middle = len(whole) // 2
    damage = [whole[:middle] + [damaged] + whole[middle + 1 :] for damaged in ("{}", "[", whole[middle].replace('"hashSelf":"', '"hashSelf":"0'), whole[middle - 1])]
    for text in (whole, *damage):
        rows = [("d", n, x) for n, x in enumerate(text, 1) if n > 1]
        want = sorted(i for i in audit_chain.verify_text("\n".join(text))["issues"] if not i.startswith("header count"))
        for at in (middle - 2, middle - 1, middle):
            # One task reads two runs, as another document stands between them.
            lines = spark.createDataFrame([*rows[:at], ("e", 2, whole[1]), *rows[at:]], "doc string, line_no long, line string").coalesce(1)
            assert sorted(r.issue for r in audit_chain.issues(audit_chain.check_lines(lines)).collect()) == want


def test_a_session_is_one_task_whatever_dealt_out_its_records(spark, path):
    """The fold has a shuffle of its own above a union of parts that are dealt out by session already."""
    rows = payloads.unnumbered(read_ledger(spark, path).records)
    dealt = rows.repartition(4, "session_key").unionByName(rows.repartition(4, "session_key"))
    plan = audit_chain.documents(dealt, at=0, order=payloads.ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Union")


def test_the_fold_numbers_records_as_payloads_are_numbered(spark, path):
    rows = read_ledger(spark, path).records
    numbered = audit_chain.documents(payloads.payloads(rows), at=0)
    folded = audit_chain.documents(payloads.unnumbered(rows), at=0, order=payloads.ORDER)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, numbered.collect()))
    assert folded.filter("line_no = 1").count() == 1
