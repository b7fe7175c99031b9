"""Risk of effects: severities and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.deletes import delete_verdict, once
from auditloom.operators.effects import backslashes
from auditloom.schemas import SEVERITIES

#: What makes a path sensitive; the first that matches names the flag. Case doesn't count.
SENSITIVE = [
    (r"(^|[\\/])\.env(\..*)?\z", "dotenv"),
    (r"(^|[\\/])id_(rsa|dsa|ecdsa|ed25519)(\.pub)?\z", "ssh-key"),
    (r"(^|[\\/])\.(ssh|aws|gnupg|docker)[\\/]", "credential-dir"),
    (r"(^|[\\/])\.npmrc\z", "npmrc"),
    (r"(^|[\\/])\.git-credentials\z", "git-credentials"),
    (r"(^|[\\/])\.git[\\/]config\z", "git-config"),
    (r"\.(pem|pfx|p12|key|keystore|jks)\z", "key-material"),
    (r"(secret|credential|passwd|password|apikey|api_key|access_token)", "secret-named"),
    (r"(^|[\\/])\.dsh[\\/]profiles[\\/]", "dsh-profile"),
]
#: Commands that destroy; every one that matches counts. Case doesn't count.
DESTRUCTIVE = [
    (r"\brm\s+(-[a-z]*r[a-z]*f|-[a-z]*f[a-z]*r)\b", "rm-recursive-force"),
    (r"\bRemove-Item\b[^\n]*-Recurse\b[^\n]*-Force\b", "remove-item-recursive"),
    (r"\b(Format-Volume|format\s+[a-z]:)", "format-volume"),
    (r"\bgit\s+reset\s+--hard\b", "git-reset-hard"),
    (r"\bgit\s+clean\s+-[a-z]*f", "git-clean-force"),
    (r"\b(DROP\s+(TABLE|DATABASE)|TRUNCATE\s+TABLE)\b", "sql-destructive"),
    (r"\b(npm|pnpm|yarn)\s+publish\b", "package-publish"),
    (r"\bgit\s+push\b[^\n]*--force\b", "git-push-force"),
    (r"\b(shutdown|Stop-Computer|Restart-Computer)\b", "host-power"),
    (r"[>]{1,2}\s*[A-Za-z]:[\\/](Windows|Program Files)", "system-path-write"),
    (r"\bcurl\b[^\n]*\|\s*(ba|z|fi)?sh\b", "pipe-to-shell"),
    (r"\b(Invoke-Expression|iex)\b", "invoke-expression"),
]
#: Of these the target decides; these are high, all others critical.
BY_TARGET, HIGH = ("rm-recursive-force", "remove-item-recursive"), ("package-publish", "host-power")


def rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; -1 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int"), F.lit(0)) - 1


def named(rank_column: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank_column + 1)


def sensitive_flag(path: Column) -> Column:
    """The flag of the first sensitive pattern that matches, or null."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SENSITIVE):
        out = F.when(path.rlike(f"(?i){pattern}"), f"sensitive-path:{name}").otherwise(out)
    return out


def outside_workspace(path: Column, cwd: Column) -> Column:
    """Whether a path lies outside the working directory; case doesn't count, and without one nothing does."""
    p, root = F.lower(backslashes(path)), F.regexp_replace(F.lower(backslashes(cwd)), r"\\+\z", "")
    return F.coalesce((cwd != "") & ~p.startswith(F.concat(root, F.lit("\\"))) & (p != root), F.lit(False))


_VERDICTS = "array<struct<severity:string,flag:string>>"


def delete_verdicts(command: Column, cwd: Column) -> Column:
    """The verdicts on the first recursive delete of each kind that a command has."""

    def one(pattern: str) -> Column:
        at = F.regexp_instr(command, F.lit(f"(?i){pattern}"))
        return F.when(at > 0, delete_verdict(command, cwd, at - 1))

    return F.filter(F.array(*[one(p) for p, n in DESTRUCTIVE if n in BY_TARGET]), lambda v: v.isNotNull())


def has_delete(source: Column) -> Column:
    return source.rlike("(?i)" + "|".join(f"(?:{p})" for p, n in DESTRUCTIVE if n in BY_TARGET))


def delete_targets(effects: DataFrame) -> DataFrame:
    """Shell effects with a recursive delete, and the verdict on each."""
    return effects.filter((F.col("kind") == "shell") & has_delete(F.col("source"))).withColumn("verdicts", delete_verdicts(F.col("source"), F.col("cwd")))


def assessed(kind: Column, fidelity: Column, path: Column, source: Column, undecidable: Column, cwd: Column) -> Column:
    """Severity and flags (a struct) of one effect; only commands with a recursive delete have their targets read."""
    shell, writes = F.coalesce((kind == "shell") & (source != ""), F.lit(False)), kind.isin("write", "edit")
    destroys = F.array(*[F.when(source.rlike(f"(?i){p}"), n) for p, n in DESTRUCTIVE if n not in BY_TARGET])
    # What is looked up once, bound by names: expressions that use it twice don't repeat it.
    looked = F.named_struct(
        F.lit("verdicts"), F.when(shell & has_delete(source), delete_verdicts(source, cwd)).otherwise(F.array().cast(_VERDICTS)),
        F.lit("sensitive"), sensitive_flag(F.when(path != "", path)), F.lit("outside"), F.when(writes & (path != ""), outside_workspace(path, cwd)).otherwise(F.lit(False)),
        F.lit("destroys"), F.when(shell, F.filter(destroys, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>")),
    )

    def judged(found: Column) -> Column:
        verdicts, sensitive, outside, own = (found[n] for n in ("verdicts", "sensitive", "outside", "destroys"))
        worst = F.greatest(F.array_max(F.transform(verdicts, lambda v: rank(v["severity"]))), F.array_max(F.transform(own, lambda n: F.when(n.isin(*HIGH), 3).otherwise(4))), F.lit(2))
        secret = F.when(sensitive.isNotNull(), 4).otherwise(0)
        level = (
            F.when(kind == "read", secret).when(writes, F.greatest(secret, F.when(outside, 3).otherwise(1)))
            .when(kind == "shell", worst).when(kind == "network", 1).when(kind == "unknown", 2).otherwise(0)
        )
        flags = F.concat(
            F.array(sensitive, F.when(outside, "outside-workspace"), F.when(kind == "shell", "shell"), F.when((kind == "shell") & undecidable, "effects-undecidable"), F.when(kind == "unknown", "unclassified-tool")),
            F.transform(verdicts, lambda v: v["flag"]), F.transform(own, lambda n: F.concat(F.lit("destructive:"), n)),
            F.array(F.when(writes & (fidelity == "partial"), "partial-fidelity")),
        )
        return F.named_struct(F.lit("severity"), named(level), F.lit("flags"), F.filter(flags, lambda x: x.isNotNull()))

    return once(looked, judged)


def assess(effects: DataFrame) -> DataFrame:
    """``effects`` (kind, fidelity, path, source, undecidable, cwd) with severity and flags, in projections alone."""
    found = effects.withColumn("_risk", assessed(*[F.col(c) for c in ("kind", "fidelity", "path", "source", "undecidable", "cwd")]))
    return found.withColumns({"severity": F.col("_risk.severity"), "flags": F.col("_risk.flags")}).drop("_risk")


def severity_histogram(rows: DataFrame, *by: str) -> DataFrame:
    """severity, n for all five severities."""
    counts = rows.groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.lit(s) for s in SEVERITIES]))
    grid = rows.sparkSession.range(1).select(every.alias("severity")) if not by else rows.select(*by).distinct().withColumn("severity", every)
    return grid.join(counts, [*by, "severity"], "left").select(*by, "severity", F.coalesce("n", F.lit(0)).alias("n"))


def at_least(rows: DataFrame, severity: str) -> DataFrame:
    """Rows of that severity and above, the most severe and then the oldest first."""
    return rows.filter(rank(F.col("severity")) >= SEVERITIES.index(severity)).orderBy(F.desc(rank(F.col("severity"))), "ts")
