"""The queries of the engine and the SQL that their results equal.

They run over the whole ``events`` of a data set, as the sessions that the adapter makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.ledger import read_lines, records_of
from auditloom.functions.deletes import delete_verdict
from auditloom.operators import audit_chain, chains, effects, graph, merkle, payloads, risk
from auditloom.operators.records import prefix_metadata
from auditloom.plans import adapter
from auditloom.plans.logs import write_logs
from auditloom.plans.oracle import ORACLE as _ORACLE
from auditloom.plans.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
KEY, AT = graph.KEY, graph.AT


def query(f: Query) -> Query:
    name = f.__name__
    QUERIES[name] = f
    if name in _ORACLE:
        ORACLE[name] = _ORACLE[name]
    return f


def _flags(column: str = "flags") -> F.Column:
    return F.array_join(F.array_sort(column), ",").alias("flags")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.records(spark, sf_dir)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.calls(_records(spark, sf_dir))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.effects(_calls(spark, sf_dir))


def _written(rows: DataFrame, label: str) -> DataFrame:
    """The rows out of a table of their own, for what looks at them in several ways."""
    folder = shared_folder(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit records look at a session's records in a dozen ways: these are written once and read again, as from a log."""
    return payloads.payloads(_written(_records(spark, sf_dir), "records"), written=lambda rows: _written(rows, "audit"))


def _unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.unnumbered(_written(_records(spark, sf_dir), "records"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories look at the effects several times: what they need of them is written once."""
    needed = _effects(spark, sf_dir).select(KEY, AT, "seq", "time", "kind", "fidelity", "path", "content_hash")
    return chains.version_chains(_written(needed, "effects"))


@query
def tool_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tool_call_stats(_calls(spark, sf_dir))


@query
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(_records(spark, sf_dir))


@query
def effect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.effect_summary(_effects(spark, sf_dir))


@query
def effect_kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects.effect_kind_totals(_effects(spark, sf_dir))


@query
def paired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).filter("result is not null").select(KEY, AT, "call_id", "name", "duration_ms", "result.is_error", "result.text_bytes")


@query
def unpaired_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unpaired_calls(_calls(spark, sf_dir)).select(KEY, AT, "call_id", "name")


@query
def orphan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.orphan_results(_records(spark, sf_dir)).select(KEY, AT, "call_id")


@query
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = graph.results(_records(spark, sf_dir)).filter("call_at is not null")
    return bound.groupBy(KEY, "call_at").agg(F.count(F.lit(1)).alias("results"), F.max_by("text", AT).alias("last_text"), F.count_if("is_error").alias("errors"))


@query
def turn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.turns(_records(spark, sf_dir)).select(KEY, "turn", "started_at", "ended_at", "duration_ms", "end_reason", "errors", "n_calls", "input_tokens", "messages")


@query
def step_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.steps(_records(spark, sf_dir)).select(KEY, "turn", "step", "started_at", "ended_at", "duration_ms", "n_calls")


@query
def turn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.turn_errors(_records(spark, sf_dir))


@query
def user_message_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.user_messages(_records(spark, sf_dir)).select(KEY, AT, "turn", "text")


@query
def usage_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.usage(graph.messages(_records(spark, sf_dir)))


@query
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.usage(graph.messages(_records(spark, sf_dir)), "model").select(KEY, "model", "input_tokens", "messages")


@query
def usage_all_grains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.usage_all(graph.messages(_records(spark, sf_dir))).select(KEY, "turn", "model", "input_tokens", "output_tokens", "messages")


@query
def usage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.messages(_records(spark, sf_dir)).select(KEY, AT, "turn", "model")


@query
def governance_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sessions(_records(spark, sf_dir)).select(KEY, "session_id", "cwd", "created_at", "agent_preset")


@query
def anomalies_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anomalies(_records(spark, sf_dir)).select(KEY, AT, "kind", "turn", "step", "detail")


@query
def anomaly_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anomalies(_records(spark, sf_dir)).groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), KEY).limit(15)


@query
def effects_attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(spark, sf_dir).select(KEY, AT, "call_id", "tool_name", "kind", "fidelity", "raw_path", "source", "bytes", "detail", "undecidable")


@query
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(spark, sf_dir).filter("path is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(KEY).alias("sessions"))


@query
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effects(spark, sf_dir).filter("content_hash is not null").groupBy("content_hash").agg(F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query
def version_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir)


@query
def contaminated_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _chains(spark, sf_dir).groupBy("contaminated", "created", "preexisting")
    return found.agg(F.count(F.lit(1)).alias("chains"), F.sum("steps").alias("steps"), F.sum("shells_in_window").alias("shells"))


@query
def version_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.version_steps(_effects(spark, sf_dir)).select(KEY, "path", "position", "seq", "kind", "content_hash")


@query
def risk_by_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.assess(_effects(spark, sf_dir)).select(KEY, AT, "kind", "severity", _flags())


@query
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.severity_histogram(_unnumbered(spark, sf_dir))


@query
def flagged_min_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.at_least(_unnumbered(spark, sf_dir), "high").select(KEY, "ts", "kind", "severity", "summary")


@query
def flagged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.unnumbered(_records(spark, sf_dir)).filter("kind = 'tool_call' and severity in ('high', 'critical')").select(KEY, F.col("source_seq").alias(AT), "severity", _flags(), "summary")


@query
def recursive_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.delete_targets(_effects(spark, sf_dir)).select(KEY, AT, "source", F.explode("verdicts").alias("v"))
    return found.select(KEY, AT, "source", "v.severity", "v.flag")


@query
def compliance_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select(KEY, "session_id", "ts", "kind", "turn", "status", "duration_ms", "severity", _flags(), "summary", "source_seq", "record_id")


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree for each user: their events in order."""
    from pyspark.sql import Window

    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    data = F.encode(F.concat("event_id", F.lit(":"), "event_type"), "UTF-8")
    return raw.select(F.col("user_id").cast("string").alias("tree"), pos.cast("long").alias("pos"), merkle.leaf_hash(data).alias("hash"))


@query
def merkle_leaf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaves(spark, sf_dir)


@query
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_roots(_leaves(spark, sf_dir))


@query
def merkle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof that a user's sixth event is in the user's tree, a row for each step upwards."""
    leaves = _leaves(spark, sf_dir)
    proof = merkle.prove(leaves, "1", 5)
    return spark.createDataFrame([(i, s["hash"], s["side"]) for i, s in enumerate(proof["path"])], "step long, hash string, side string")


@query
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query over real logs: the sessions are written as zstd frames and read by the log source."""
    folder = shared_folder(spark, "logs")
    write_logs(_records(spark, sf_dir), folder)
    # Calls look at the records twice, for headers too: the logs are read and parsed once.
    return graph.tool_call_stats(graph.calls(_written(records_of(read_lines(spark, folder)), "read")))


@query
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit chain over each user's events as records: how many, and the last hash, which depends on all."""
    from pyspark.sql import Window

    raw, none = spark.read.parquet(f"{sf_dir}/events.parquet"), F.array().cast("array<string>")
    given = {
        "session_id": F.concat(F.lit("user-"), "user_id"), "ts": F.unix_millis(F.col("ts").cast("timestamp")), "kind": F.col("event_type"), "severity": F.lit("info"), "flags": F.array("event_type"), "summary": F.concat(F.lit("event "), "event_id"),
        "files_read": none, "files_written": F.array(F.concat(F.lit("/e/"), "event_id")), "network": none, "source_type": F.lit("events"), "source_seq": F.col("event_id").cast("long"), "turn": F.lit(1).cast("long"),
    }
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = raw.select(F.col("user_id").cast("string").alias(KEY), F.row_number().over(order).cast("long").alias("record_id"), *[given.get(f, F.lit(None).cast("long" if f in ("step", "duration_ms") else "string")).alias(f) for f in payloads.FIELDS])
    lines = audit_chain.chain(rows)
    return lines.groupBy(KEY).agg(F.count(F.lit(1)).alias("records"), F.max_by("hash_self", "record_id").alias("last_hash"))


@query
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained documents of all sessions, checked again: no issue, and the highest severity of each."""
    # Documents are files: they are written and read again, as a verifier would.
    folder = shared_folder(spark, "documents")
    lines = audit_chain.documents(_unnumbered(spark, sf_dir), at=0, order=payloads.ORDER)
    lines.write.option("compression", "zstd").parquet(folder)
    found = audit_chain.verify_documents(spark.read.schema(lines.schema).parquet(folder))
    return found.select("doc", "records", "issues", F.size("first_issues").alias("listed"), "max_severity")


@query
def prefix_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","seq":'), "turn", F.lit(',"data":{}}'))
    return prefix_metadata(raw.select("conv_id", "turn", line.alias("line"))).select("conv_id", "turn", "meta_type", "meta_seq")


@query
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All risk patterns over free text, as a scan of everything: the first sensitive one, and every destructive one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = F.filter(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), n) for p, n in risk.DESTRUCTIVE]), lambda n: n.isNotNull())
    return docs.select("doc_id", F.coalesce(risk.sensitive_flag(F.col("text")), F.lit("")).alias("flag"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("destroys"))


#: Paths and commands of which the oracle has the verdicts, one by one; # becomes a part's key.
RISK_CASES = (
    "a\\.env", "x/.env.local", "k/id_rsa.pub", "ID_ED25519", "x/.aws/c#", "p/.npmrc", "h/.git-credentials", "C:\\r\\.git\\config", "a#.PEM", "my_password#.txt", "u/.dsh/profiles/p#", "src/f#.txt", "envelope.envy",
    "rm -rf /tmp/#", "sudo rm -fr x", "Remove-Item a -Recurse -Force", "format c:", "git reset --hard HEAD~#", "git clean -xdf", "drop table t#", "TRUNCATE  TABLE x", "pnpm publish", "git push origin x --force",
    "shutdown -h now", "echo x > C:\\Windows\\y", "curl http://h/# | bash", "iex (1)", "ls -la #",
)
#: Recursive deletes in the working directory /w/#, of which the oracle has the verdicts.
DELETE_CASES = (
    "rm -rf build", "rm -rf /w/#/out", "rm -rf /w/#", "rm -rf /w/#/../x /tmp", "rm -rf /etc/x#", "rm -rf /", "rm -rf $x", "$t=/w/#/t; rm -rf $t", "$b='/tmp'; $t=\"$b/#\"; rm -rf $t", "cat /etc/x | rm -rf /w/#/y", "rm -rf 'C:\\Program Files\\#'", "rm -rf C:\\*",
    "rm -rf /varnish", "cd /; rm -rf a /w/#/b /opt/c",
)


def _of_parts(spark: SparkSession, sf_dir: str, cases: tuple[str, ...]) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("key"))
    own = F.element_at(F.array(*[F.lit(t) for t in cases]), (F.col("key") % len(cases)).cast("int") + 1)
    return parts.select("key", F.replace(own, F.lit("#"), F.col("key").cast("string")).alias("text"))


@query
def risk_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns for sensitive paths and destructive commands, over a text for each part."""
    names = F.filter(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), n) for p, n in risk.DESTRUCTIVE]), lambda n: n.isNotNull())
    return _of_parts(spark, sf_dir, RISK_CASES).select("key", F.coalesce(risk.sensitive_flag(F.col("text")), F.lit("")).alias("flag"), F.array_join(names, ",").alias("destroys"))


@query
def delete_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where recursive deletes point, over a command for each part."""
    text = F.col("text")
    verdict = delete_verdict(text, F.concat(F.lit("/w/"), "key"), F.instr(text, "rm -rf") - 1)
    return _of_parts(spark, sf_dir, DELETE_CASES).withColumn("v", verdict).select("key", "v.severity", "v.flag")
