"""Command line: list, report, classify, pack, verify, keygen."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from auditloom import report
from auditloom.ledger import attest, read_ledger
from auditloom.operators.audit_chain import verify_with
from auditloom.operators.manifest import generate_key, verify_manifest, verify_signature
from auditloom.schemas import SEVERITIES
from auditloom.sources.discover import find_session_logs, resolve_log


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="auditloom", description="Audit analytics over agent session logs.")
    top.add_argument("--home", default=os.environ.get("AUDITLOOM_HOME", str(Path.home() / ".auditloom")), help="folder that has sessions/<project>/<session>/")
    commands = top.add_subparsers(dest="command")
    commands.add_parser("list", help="session logs, newest first").add_argument("--json", action="store_true")
    for name, text in (("report", "what a session did"), ("classify", "effects and risk levels")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("log", help="a log, or a session id or part of one")
        sub.add_argument("--json", action="store_true")
        if name == "classify":
            sub.add_argument("--min-severity", default="info", choices=SEVERITIES)
    sub = commands.add_parser("pack", help="write an evidence pack")
    sub.add_argument("log")
    sub.add_argument("-o", "--out", required=True, help="a folder, or a .zip file")
    sub.add_argument("--key", help="an Ed25519 private key to sign with")
    sub.add_argument("--title", default="Evidence from a session log")
    sub = commands.add_parser("verify", help="check a pack's folder or its compliance.jsonl")
    sub.add_argument("target")
    sub.add_argument("--manifest")
    sub.add_argument("--log")
    sub.add_argument("--verifier", help="a package with verify_compliance_jsonl whose verdict is to count")
    commands.add_parser("keygen", help="make an Ed25519 key").add_argument("--out", default="ledger-key.pem")
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("auditloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _verify(args: argparse.Namespace) -> int:
    target = Path(args.target)
    if target.suffix.lower() == ".zip":
        print("unpack the .zip first, then name its folder", file=sys.stderr)
        return 1
    chain = verify_with((target / "compliance.jsonl" if target.is_dir() else target).read_text(encoding="utf-8"), args.verifier)
    found = Path(args.manifest) if args.manifest else target / "manifest.json" if target.is_dir() else None
    verdict: dict[str, object] = {"chain": chain | {"issues": chain["issues"][: report.ISSUES]}}
    ok = chain["valid"]
    if found and found.is_file():
        manifest, spark = json.loads(found.read_text()), session()
        signed = verify_signature(spark, manifest) if manifest.get("signature") else None
        verdict["manifest"] = {"frames": manifest["frames"], "records": manifest["records"], "signature": {True: "valid", False: "invalid", None: "absent"}[signed]}
        ok = ok and signed is not False
        if args.log:
            verdict["log"] = result = verify_manifest(spark, args.log, manifest)
            ok = ok and result["ok"]
    print(json.dumps({"valid": ok} | verdict, indent=2, default=str))
    return 0 if ok else 1


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    if args.command == "verify":
        return _verify(args)
    spark = session()
    if args.command == "keygen":
        target = Path(args.out)
        target.parent.mkdir(parents=True, exist_ok=True)
        with open(os.open(target, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            f.write(generate_key())
        print(f"wrote {target} (Ed25519). Keep it secret; share the public half.")
        return 0
    if args.command == "list":
        logs = report.View("Logs", find_session_logs(spark, args.home), (F.desc("modified_at"), F.col("path")))
        print(json.dumps(report.as_data([logs])["logs"], indent=2) if args.json else report.as_text([logs], report.LISTED))
        return 0
    try:
        path = resolve_log(spark, args.log, args.home)
    except LookupError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.command == "pack":
        done = report.pack(spark, path, args.out, args.key, args.title)
        print(json.dumps({"out": args.out, "files": done["files"], "records": done["records"], "severity": done["severity"], "chain_valid": done["chain"]["valid"], "signed": "signature" in done["manifest"]}, indent=2))
        return 0 if done["chain"]["valid"] else 1
    ledger = read_ledger(spark, path)
    if args.command == "report":
        manifest = attest(spark, path)
        roots = {k: manifest[k] for k in ("frameRoot", "recordRoot", "bytes")}
        views = report.overview(ledger)
        print(json.dumps({"path": path, "integrity": roots} | report.as_data(views), indent=2, default=str) if args.json else report.as_text(views) + "\n".join(["## Integrity", "", *[f"- {k}: {v}" for k, v in roots.items()]]))
    else:
        print(json.dumps(report.classify(ledger, args.min_severity), indent=2) if args.json else report.as_text(report.risks(ledger, args.min_severity)))
    return 0
