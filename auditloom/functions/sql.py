"""Named functions for SQL.

``register_functions(spark)`` adds, to the session: resolve_path, sensitive_flag, severity_rank, classify_delete
and assess_effect (SQL functions that the optimizer inlines), stable_json (Arrow), merkle_root (an
aggregate over hex digests of a group that fits a task) and walk_frames (a table function over a binary).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.deletes import delete_verdict
from auditloom.functions.jsonish import dump, parse
from auditloom.operators.merkle import merkle_root
from auditloom.operators.risk import SENSITIVE, assessed
from auditloom.plans.workers import reach
from auditloom.schemas import SEVERITIES, TRIM_CLASS
from auditloom.sources.frames import Corrupt, Frame, walk


def _text(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


#: Operators that a column's text writes like functions, and the pieces of such a text.
_INFIX = frozenset(["=", "<", ">", "<=", ">=", "+", "-", "*", "/", "and", "or"])
_PIECES = re.compile(r"'(?:[^'\\]|\\.)*'|\w[\w.]*|[(),]|\s+|[^\s\w'(),]+", re.DOTALL)


def sql_of(column: Column) -> str:
    """A column of calls, lambdas and literals as SQL, its operators between their operands."""
    pieces = _PIECES.findall(column._jc.node().sql())

    def arguments(at: int) -> tuple[list[str], int]:
        found = [""]
        while at < len(pieces) and pieces[at] != ")":
            piece, at = pieces[at], at + 1
            if piece == ",":
                found.append("")
            elif piece.lower() in _INFIX and pieces[at] == "(":
                inner, at = arguments(at + 1)
                found[-1] += "(" + f" {piece} ".join(inner) + ")"
            elif piece == "(":
                inner, at = arguments(at)
                found[-1] += "(" + ",".join(inner) + ")"
            else:
                found[-1] += piece
        return found, at + 1

    return ",".join(arguments(0)[0])


def _stable(text: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else dump(parse(t), ordered=True)
        except ValueError:
            return None

    return text.map(one)


class WalkFrames:
    """The frames at the beginning of a binary, and what stands behind them."""

    def eval(self, data: bytes) -> Iterator[tuple]:
        at = 0
        while data is not None:
            found = walk(data, at)
            if isinstance(found, Frame):
                yield "frame", found.start, found.end, found.content_size, found.skippable, found.blocks, None
                at = found.end
                continue
            if isinstance(found, Corrupt):
                yield "corrupt", at, None, None, None, None, found.reason
            elif found is not None:
                yield "incomplete", at, None, None, None, None, f"needs {found.need} bytes"
            return


def register_functions(spark: SparkSession) -> None:
    reach(spark)
    trimmed = f"regexp_replace(regexp_replace(raw, {_text(f'^{TRIM_CLASS}+|{TRIM_CLASS}+' + chr(92) + 'z')}, ''), {_text('^\"|\"' + chr(92) + 'z')}, '')"
    absolute = f"({trimmed} rlike {_text('^[a-zA-Z]:[' + chr(92) * 2 + '/]')} or startswith({trimmed}, r'{chr(92) * 2}') or startswith({trimmed}, '/'))"
    spark.sql(f"""create or replace temporary function resolve_path(raw string, cwd string) returns string return
        case when {trimmed} = '' then {trimmed} when {absolute} or coalesce(cwd, '') = '' then translate({trimmed}, '/', r'{chr(92)}')
        else concat(regexp_replace(cwd, {_text('[' + chr(92) * 2 + '/]+' + chr(92) + 'z')}, ''), r'{chr(92)}', translate({trimmed}, '/', r'{chr(92)}')) end""")
    cases = " ".join(f"when path rlike {_text('(?i)' + p)} then 'sensitive-path:{n}'" for p, n in SENSITIVE)
    spark.sql(f"create or replace temporary function sensitive_flag(path string) returns string return case {cases} end")
    levels = ", ".join(f"'{s}'" for s in SEVERITIES)
    spark.sql(f"create or replace temporary function severity_rank(severity string) returns int return cast(array_position(array({levels}), severity) - 1 as int)")
    verdict = sql_of(delete_verdict(F.col("command"), F.col("cwd"), F.col("at")))
    spark.sql(f"create or replace temporary function classify_delete(command string, cwd string, at int) returns struct<severity:string,flag:string> return {verdict}")
    names = ("kind", "fidelity", "path", "source", "undecidable", "cwd")
    risk = sql_of(assessed(*[F.col(n) for n in names]))
    spark.sql(f"""create or replace temporary function assess_effect(kind string, fidelity string, path string, source string, undecidable boolean, cwd string)
        returns struct<severity:string,flags:array<string>> return {risk}""")
    spark.udf.register("stable_json", F.pandas_udf(_stable, T.StringType()))
    spark.udf.register("merkle_root", merkle_root)
    spark.udtf.register("walk_frames", F.udtf(WalkFrames, returnType="kind string, start bigint, end bigint, content_size bigint, skippable boolean, blocks int, detail string"))
