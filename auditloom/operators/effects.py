"""Effects of tool calls: what each call did, as far as the log can tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.schemas import EFFECT_KINDS, TRIM_CLASS

#: The tools of each group.
WRITE, EDIT, READ = ("write",), ("edit",), ("read", "read_image")
SEARCH, SHELL, NETWORK = ("grep", "glob"), ("pwsh", "bash", "shell"), ("web_search", "web_fetch")
DELEGATION = ("subagent", "subagent_fork", "send_message", "interrupt_agent", "workflow", "ralph")
CONTROL = ("todo_write", "job_output", "job_kill", "job_list", "ask_user_question", "exit_plan_mode", "create_goal", "update_goal", "get_goal")
PATH_KEYS = ("file_path", "path", "filePath")

_BACKSLASH = "\\"


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"^{TRIM_CLASS}+|{TRIM_CLASS}+\z", "")


def backslashes(path: Column) -> Column:
    return F.translate(path, "/", _BACKSLASH)


def resolve_path(raw: Column, cwd: Column) -> Column:
    """A path for grouping: absolute ones with backslashes, others behind the working directory.

    No '.' or '..' is folded, and the working directory keeps its own separators.
    """
    p = F.regexp_replace(trimmed(raw), r'^"|"\z', "")
    absolute = p.rlike(r"^[a-zA-Z]:[\\/]") | p.startswith("\\\\") | p.startswith("/")
    under = F.concat(F.regexp_replace(cwd, r"[\\/]+\z", ""), F.lit(_BACKSLASH), backslashes(p))
    return F.when(p == "", p).when(absolute | F.coalesce(cwd == "", F.lit(True)), backslashes(p)).otherwise(under)


def argument(*keys: str) -> Column:
    """The first of the named arguments that is a non-empty string."""
    return F.coalesce(*[F.nullif(F.element_at("args", F.lit(k)), F.lit("")) for k in keys], F.lit(None).cast("string"))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def effects_of(calls: DataFrame) -> DataFrame:
    """``calls`` (name, args, args_json, replace_all, cwd) with one effect each.

    Adds kind, fidelity, raw_path, path, content_hash, bytes, source, detail and undecidable.
    """
    name, cwd, empty = F.col("name"), F.col("cwd"), F.lit("")
    raw = F.col("_raw")
    is_a = {k: name.isin(*v) for k, v in (("write", WRITE), ("edit", EDIT), ("read", READ), ("search", SEARCH), ("shell", SHELL), ("network", NETWORK), ("delegation", DELEGATION), ("control", CONTROL))}
    pathless = (is_a["write"] | is_a["edit"] | is_a["read"]) & raw.isNull()
    kind = F.when(pathless, "unknown")
    for k, test in is_a.items():
        kind = kind.when(test, k)
    kind = kind.otherwise("unknown")
    fidelity = F.when(F.col("kind") == "write", "exact").when(F.col("kind") == "edit", "partial").when(F.col("kind") == "shell", "undecidable").when(F.col("kind") == "unknown", "opaque").otherwise("observed")
    search_root = F.coalesce(argument("path"), cwd)
    content = F.col("_content")
    has_content = F.col("kind").isin("write", "edit")
    old = F.octet_length(F.coalesce(argument("old_string", "oldText"), empty))
    command, query, pattern = (F.coalesce(argument(*k), empty) for k in (("command",), ("query", "url"), ("pattern",)))
    offset, limit = (F.element_at("args", F.lit(k)) for k in ("#offset", "#limit"))
    include = F.element_at("args", F.lit("#include"))
    window = F.concat(F.lit("read a window (offset "), F.coalesce(offset, F.lit("0")), F.lit(", limit "), F.coalesce(limit, F.lit("end")), F.lit(")"))
    source = (
        F.when(F.col("kind") == "search", pattern).when(F.col("kind") == "shell", command).when(F.col("kind") == "network", query)
        .when(F.col("kind") == "delegation", F.coalesce(argument("description", "subagent_id", "objective"), name))
        .when(F.col("kind") == "control", F.coalesce(argument("job_id", "objective"), empty))
        .when((F.col("kind") == "unknown") & ~pathless, F.substring("args_json", 1, 512))
    )
    detail = (
        F.when(pathless, F.concat(name, F.lit(" without a path")))
        .when(F.col("kind") == "write", F.concat(F.lit("wrote "), F.col("bytes"), F.lit(" bytes")))
        .when(F.col("kind") == "edit", F.concat(F.lit("replaced "), old, F.lit(" bytes with "), F.col("bytes"), F.when(F.col("replace_all"), " (all occurrences)").otherwise("")))
        .when(F.col("kind") == "read", F.when(offset.isNotNull() | limit.isNotNull(), window).otherwise("read the file"))
        .when(F.col("kind") == "search", F.concat(F.lit("searched for "), quoted(pattern), F.coalesce(F.concat(F.lit(" in "), include), empty)))
        .when(F.col("kind") == "shell", F.coalesce(argument("description"), F.concat(F.lit("ran "), F.substring(command, 1, 80))))
        .when(F.col("kind") == "network", F.concat(F.lit("queried "), quoted(F.substring(query, 1, 80))))
        .when(F.col("kind") == "delegation", F.concat(F.lit("delegated work via "), name))
        .when(F.col("kind") == "control", F.concat(F.lit("called "), name))
        .otherwise(F.concat(F.lit("unrecognised tool "), name))
    )
    raw_path = F.when(F.col("kind").isin("write", "edit", "read"), raw).when(F.col("kind") == "search", search_root)
    written = F.when(is_a["write"], F.coalesce(argument("content"), empty)).when(is_a["edit"], F.coalesce(argument("new_string", "newText"), empty))
    return (
        calls.withColumns({"_raw": argument(*PATH_KEYS), "_content": written}).withColumn("kind", kind)
        .withColumns({"fidelity": fidelity, "raw_path": raw_path, "content_hash": F.when(has_content, sha256(content)), "bytes": F.when(has_content, F.octet_length(content)).cast("long"), "source": source})
        # An empty root of a search gives no path.
        .withColumns({"path": F.when((F.col("kind") != "search") | (F.col("raw_path") != ""), resolve_path(F.col("raw_path"), cwd)), "detail": detail, "undecidable": F.col("kind").isin("shell", "unknown")})
        .drop("_raw", "_content")
    )


def effect_summary(effects: DataFrame, *by: str) -> DataFrame:
    """kind, n: how many effects of each kind, those without any too."""
    kinds = effects.sparkSession.createDataFrame([(k,) for k in EFFECT_KINDS], "kind string")
    counts = effects.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))
    grid = F.broadcast(kinds) if not by else effects.select(*by).distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in EFFECT_KINDS])))
    return grid.join(counts, [*by, "kind"], "left").select(*by, "kind", F.coalesce("n", F.lit(0)).alias("n"))


def effect_kind_totals(effects: DataFrame, *by: str) -> DataFrame:
    """kind, n: only kinds that occur."""
    return effects.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))
