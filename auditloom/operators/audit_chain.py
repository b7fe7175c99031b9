"""Hash-chained audit documents: writing them and checking them.

Writing is a fold by nature: a line's hash needs the one before. A session's lines are streamed in order
through one task, with the last hash carried. Checking isn't: each line's hash is recomputed
from the hash that the line before claims, so all lines are checked side by side. Lines that
stand one after the other in a file are checked where they are read; only the first and last lines of such
runs are matched over tasks.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.jsonish import dump, parse
from auditloom.operators.payloads import FIELDS, KEY
from auditloom.schemas import CANONICAL_PREFIX, COMPLIANCE_SCHEMA, SEVERITIES, SEVERITY_RANK, TRIMMED


#: Lines of a stretch in which runs are matched as one group.
SPAN = 1 << 16
#: The name of the verifier here, beside a verdict.
VERIFIER = "auditloom"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


#: The fields' names in a document.
NAMES = {f: _camel(f) for f in FIELDS}


def as_payload(row: dict[str, Any]) -> dict[str, Any]:
    """A row of payloads as the object that documents hold."""
    return {NAMES[f]: row[f] for f in FIELDS}


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def document_hash(prev: str, line: dict[str, Any]) -> str:
    """The hash of a line: what came before, and the line's number, previous hash and payload."""
    return sha256(f"{prev}\n{dump(line, ordered=True)}\n")


def canonical_record(payload: dict[str, Any]) -> str:
    """A record's fields as an array behind the format's prefix, flags sorted and each once."""
    values = [sorted(set(payload[n])) if f == "flags" else payload.get(n) for f, n in NAMES.items()]
    return f"{CANONICAL_PREFIX}\n{dump(values, ordered=True)}\n"


def store_hash(prev: str | None, payload: dict[str, Any]) -> str:
    """The hash of a record in an audit store, which chains the canonical records."""
    return sha256(f"{prev or ''}\n{canonical_record(payload)}\n")


def header(count: int, hash_chain: bool = True, at: int | None = None, schema: str = COMPLIANCE_SCHEMA) -> str:
    return dump({"schema": schema, "generatedAt": int(time.time() * 1000) if at is None else at, "count": count, "hashChain": hash_chain})


def _chained(batches: Iterator[pa.RecordBatch], hash_chain: bool, numbered: bool) -> Iterator[pa.RecordBatch]:
    session, prev, place = None, "", 0
    for batch in batches:
        out: dict[str, list] = {"session_key": [], "record_id": [], "prev_hash": [], "hash_self": [], "line": []}
        for row in batch.to_pylist():
            if row[KEY] != session:
                session, prev, place = row[KEY], "", 0
            place += 1
            number = row["record_id"] if numbered else place
            signed = {"recordId": number, "prevHash": prev or None, "payload": as_payload(row)}
            own = document_hash(prev, signed)
            out["session_key"].append(session)
            out["record_id"].append(number)
            out["prev_hash"].append(prev or None)
            out["hash_self"].append(own if hash_chain else None)
            out["line"].append(dump(signed | {"hashSelf": own} if hash_chain else signed))
            prev = own if hash_chain else ""
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k == "record_id" else pa.string()) for k, v in out.items()})


def _in_order(payloads: DataFrame, order: tuple[str, ...] | None) -> DataFrame:
    # By a hash of the key: above a union of parts that joins have dealt out by the key, Spark leaves out a shuffle by the key
    # itself, and sessions were then seen in several tasks (each part's small partitions seem to be merged by themselves).
    return payloads.repartition(F.xxhash64(KEY)).sortWithinPartitions(KEY, *(order or ("record_id",)))


def chain(payloads: DataFrame, hash_chain: bool = True, order: tuple[str, ...] | None = None) -> DataFrame:
    """session_key, record_id, prev_hash, hash_self and the document's line of each record.

    Records without a number are given theirs here, from 1 in a session's ``order``: the fold passes them in order anyway.
    """
    return _in_order(payloads, order).mapInArrow(lambda it: _chained(it, hash_chain, order is None), "session_key string, record_id long, prev_hash string, hash_self string, line string")


def document(payloads: DataFrame, hash_chain: bool = True, at: int | None = None) -> Iterator[str]:
    """The lines of one session's document, streamed to the driver."""
    yield header(payloads.count(), hash_chain, at)
    for row in chain(payloads, hash_chain).orderBy("record_id").toLocalIterator():
        yield row.line


def _claims(text: str) -> dict[str, Any]:
    """What a line claims, and its text without the hash that its own hash is over."""
    try:
        value = parse(text.strip(TRIMMED))
    except ValueError:
        return {"json": False}
    line = value if isinstance(value, dict) else {}
    row: dict[str, Any] = {"json": True, "record_id": "undefined" if "recordId" not in line else dump(line["recordId"]).strip('"'), "complete": "recordId" in line and "payload" in line}
    row["hash_self"] = str(line["hashSelf"]) if line.get("hashSelf") is not None else None
    row["prev_hash"] = line.get("prevHash")
    if row["complete"]:
        payload = line["payload"]
        row["body"] = dump({"recordId": line["recordId"], "prevHash": line.get("prevHash"), "payload": payload}, ordered=True)
        severity = payload.get("severity") if isinstance(payload, dict) else None
        row["rank"] = SEVERITY_RANK.get(severity, 0) if isinstance(severity, str) else 0
    return row


_READ = pa.schema([
    ("doc", pa.string()), ("line_no", pa.int64()), ("records", pa.int64()), ("rank", pa.int32()), ("record_id", pa.string()), ("hash_self", pa.string()), ("body", pa.binary()), ("last", pa.string()),
    ("issue", pa.string()), ("chained", pa.bool_()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of lines that come one after the other, each as a row, and a row for each issue inside them."""
    run: dict[str, Any] | None = None
    at = None
    for batch in batches:
        rows: list[dict[str, Any]] = []
        for doc, line_no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or (doc, line_no) != at:
                rows += [run] if run else []
                # Nothing stands above a document's first record; above other runs, something may.
                run = {"doc": doc, "line_no": line_no, "records": 0, "rank": 0, "last": "" if line_no <= 2 else None}
            at = (doc, line_no + 1)
            line = _claims(text)
            if not line["json"]:
                rows.append({"doc": doc, "line_no": line_no, "issue": f"line {line_no}: not JSON", "chained": False})
                continue
            run["records"] += 1
            if not line["complete"]:
                rows.append({"doc": doc, "line_no": line_no, "issue": f"record {line['record_id']} missing recordId/payload", "chained": False})
                continue
            if run["last"] is None:
                run |= {"line_no": line_no, "record_id": line["record_id"], "hash_self": line["hash_self"], "body": line["body"].encode("utf-8", "surrogatepass")}
            elif line["hash_self"] is None:
                rows.append({"doc": doc, "line_no": line_no, "issue": f"record {line['record_id']} missing hashSelf", "chained": True})
            elif sha256(f"{run['last']}\n{line['body']}\n") != line["hash_self"]:
                rows.append({"doc": doc, "line_no": line_no, "issue": f"record {line['record_id']} hash mismatch", "chained": True})
            run["last"], run["rank"] = line["hash_self"] or "", max(run["rank"], line["rank"])
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _READ)
    if run:
        yield pa.RecordBatch.from_pylist([run], _READ)


def check_lines(lines: DataFrame) -> DataFrame:
    """What the records of documents (doc, line_no from 2, line) claim: a row for each run of lines, and for each issue in it.

    A run is of lines that a task reads one after the other. It has how many records it holds, their highest rank, the
    hash that its ``last`` record claims, and its first record, which can't be checked without the run above.
    Lines in no order are runs of one line.
    """
    types = "doc string, line_no long, records long, rank int, record_id string, hash_self string, body binary, last string, issue string, chained boolean"
    return lines.select("doc", F.col("line_no").cast("long"), "line").mapInArrow(_read, types)


def _with_previous(runs: DataFrame) -> DataFrame:
    """Runs with the hash that the last record of the run above claims.

    Windows reach over SPAN lines only; the last hash of each such stretch goes to the next one by a
    table with a row for each stretch, so a long document is many tasks.
    """
    cut = runs.withColumn("stretch", F.floor(F.col("line_no") / SPAN))
    ends = cut.groupBy("doc", "stretch").agg(F.max_by("last", "line_no").alias("end"))
    carried = ends.select("doc", "stretch", F.lag("end").over(Window.partitionBy("doc").orderBy("stretch")).alias("carried"))
    above = F.lag("last").over(Window.partitionBy("doc", "stretch").orderBy("line_no"))
    return cut.withColumn("above", above).join(carried, ["doc", "stretch"]).withColumn("prev", F.coalesce("above", "carried", F.lit("")))


def issues(read: DataFrame, hash_chain: bool = True) -> DataFrame:
    """doc, line_no, issue of lines as check_lines reads them."""
    told = read.filter("issue is not null" if hash_chain else "issue is not null and not chained").select("doc", "line_no", "issue")
    if not hash_chain:
        return told
    name = F.concat(F.lit("record "), F.col("record_id"))
    expected = F.sha2(F.concat(F.encode(F.concat("prev", F.lit("\n")), "UTF-8"), F.col("body"), F.encode(F.lit("\n"), "UTF-8")), 256)
    wrong = F.when(F.col("hash_self").isNull(), F.concat(name, F.lit(" missing hashSelf"))).when(expected != F.col("hash_self"), F.concat(name, F.lit(" hash mismatch")))
    # A run that begins a document without a complete line has nothing to carry on.
    firsts = _with_previous(read.filter("last is not null and (line_no > 2 or last <> '')")).filter("body is not null")
    return firsts.select("doc", "line_no", wrong.alias("issue")).filter("issue is not null").unionByName(told)


def _documents(batches: Iterator[pa.RecordBatch], numbered: bool, at: int) -> Iterator[pa.RecordBatch]:
    """Chained lines, and the header of each document behind its last one, when they are counted."""
    doc, count = None, 0
    for batch in _chained(batches, True, numbered):
        out: list[tuple[str | None, int, str]] = []
        for key, number, line in zip(*(batch.column(n).to_pylist() for n in ("session_key", "record_id", "line")), strict=True):
            if key != doc and count:
                out.append((doc, 1, header(count, at=at)))
                count = 0
            doc, count = key, count + 1
            out.append((key, number + 1, line))
        yield _lines(out)
    if count:
        yield _lines([(doc, 1, header(count, at=at))])


def _lines(rows: list[tuple[str | None, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["doc", "line_no", "line"])


def documents(payloads: DataFrame, at: int, order: tuple[str, ...] | None = None) -> DataFrame:
    """Whole documents of all sessions, header lines too: doc, line_no from 1, line. ``order`` as for ``chain``."""
    return _in_order(payloads, order).mapInArrow(lambda it: _documents(it, order is None, at), "doc string, line_no long, line string")


def _headers(lines: DataFrame, schema: str) -> DataFrame:
    """What the first line of each document says, and what is wrong with it alone."""
    top = F.from_json("line", "schema string, count double, hashChain boolean")
    read = lines.filter("line_no = 1").select("doc", F.get_json_object("line", "$").isNotNull().alias("json"), top.alias("top"))
    named = F.coalesce("top.schema", F.lit("undefined"))
    wrong = F.when(~F.col("json"), "header is not JSON").when(named != schema, F.concat(F.lit("unexpected schema: "), named))
    return read.select("doc", F.col("top.count").alias("claimed"), F.coalesce("top.hashChain", F.lit(False)).alias("hashed"), wrong.alias("issue"))


def verify_documents(lines: DataFrame, schema: str = COMPLIANCE_SCHEMA, n: int = 10) -> DataFrame:
    """Per document (doc, line_no from 1, line): records, issues, the first ``n`` of them, max_severity.

    The header's schema and count are checked, and whether it says that lines are chained. A document without a
    header line has that as an issue. What was read of the lines, a row for each run and issue, is kept on disk by Spark.
    """
    read = check_lines(lines.filter("line_no > 1")).persist(StorageLevel.DISK_ONLY)
    heads = _headers(lines, schema)
    top = read.groupBy("doc").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.max("rank"), F.lit(0)).alias("rank"))
    every = heads.join(top, "doc", "full").select("doc", "claimed", F.coalesce("hashed", F.lit(False)).alias("hashed"), F.when(F.col("hashed").isNull(), "empty document").otherwise(F.col("issue")).alias("issue"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("rank", F.lit(0)).alias("rank"))
    count_issue = F.when(F.col("claimed") != F.col("records"), F.concat(F.lit("header count "), F.format_string("%.0f", "claimed"), F.lit(" does not match "), "records", F.lit(" record(s)")))
    of_heads = every.select("doc", F.lit(1).cast("long").alias("line_no"), "issue").unionByName(every.select("doc", F.lit(1 << 62).alias("line_no"), count_issue.alias("issue"))).filter("issue is not null")
    unchained, chained = every.filter("not hashed").select("doc"), every.filter("hashed").select("doc")
    found = issues(read.join(chained, "doc", "left_semi")).unionByName(issues(read.join(unchained, "doc", "left_semi"), False)).unionByName(of_heads)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("line_no", "issue"))
    first = found.withColumn("_place", place).filter(F.col("_place") <= n).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("_place", "issue"))).alias("first"))
    counts = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).join(first, "doc")
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank") + 1)
    listed = F.coalesce(F.transform("first", lambda x: x.issue), F.array().cast("array<string>"))
    return every.join(counts, "doc", "left").select("doc", "records", F.coalesce("n", F.lit(0)).alias("issues"), listed.alias("first_issues"), severity.alias("max_severity"))


def verify_with(text: str, module: str | None = None) -> dict[str, Any]:
    """The verdict on a document, and under ``verifier`` whose it is.

    A third party's package that is installed and has ``verify_compliance_jsonl`` judges, so that the verdict isn't
    this one's own; else ``verify_text`` does. The highest severity is always read here.
    """
    own = verify_text(text)
    if module:
        try:
            judge = getattr(import_module(module), "verify_compliance_jsonl", None)
        except ImportError:
            judge = None
        if judge is not None:
            return own | dict(judge(text)) | {"maxSeverity": own.get("maxSeverity"), "verifier": module}
    return own | {"verifier": VERIFIER}


def verify_text(text: str, schema: str = COMPLIANCE_SCHEMA, strict: bool = False) -> dict[str, Any]:
    """The verdict on one document's text: valid, lines, records, issues, maxSeverity.

    ``strict`` adds issues that the format's rules leave open: a previous hash that isn't the one above,
    and numbers that don't count up from 1.
    """
    raw = [x for x in text.replace("\r\n", "\n").split("\n") if x.strip(TRIMMED)]
    if not raw:
        return {"valid": False, "lines": 0, "records": 0, "issues": ["empty document"]}
    try:
        top = parse(raw[0])
    except ValueError as e:
        return {"valid": False, "lines": len(raw), "records": 0, "issues": [f"header is not JSON: {e}"]}
    top = top if isinstance(top, dict) else {}
    found = [] if top.get("schema") == schema else [f"unexpected schema: {top.get('schema', 'undefined')}"]
    hash_chain, prev, rank, records = top.get("hashChain") is True, "", 0, 0
    for number, item in enumerate(raw[1:], 2):
        row = _claims(item)
        if not row["json"]:
            found.append(f"line {number}: not JSON")
            continue
        records += 1
        if not row["complete"]:
            found.append(f"record {row['record_id']} missing recordId/payload")
            continue
        if hash_chain:
            if row["hash_self"] is None:
                found.append(f"record {row['record_id']} missing hashSelf")
            elif sha256(f"{prev}\n{row['body']}\n") != row["hash_self"]:
                found.append(f"record {row['record_id']} hash mismatch")
        if strict:
            if row["record_id"] != str(records):
                found.append(f"record {row['record_id']} is number {records}")
            if hash_chain and (row["prev_hash"] or "") != prev:
                found.append(f"record {row['record_id']} names another previous hash")
        prev = (row["hash_self"] or "") if hash_chain else ""
        rank = max(rank, row["rank"])
    if isinstance(top.get("count"), (int, float)) and not isinstance(top["count"], bool) and top["count"] != records:
        found.append(f"header count {dump(top['count'])} does not match {records} record(s)")
    return {"valid": not found, "lines": len(raw), "records": records, "issues": found, "maxSeverity": SEVERITIES[rank]}
