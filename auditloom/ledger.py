"""The facade: a log as named, lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import graph
from auditloom.operators.chains import version_chains, version_steps
from auditloom.operators.effects import effect_summary
from auditloom.operators.manifest import build_manifest
from auditloom.operators.payloads import payloads
from auditloom.operators.records import typed
from auditloom.sources.sessionlog import register


def read_lines(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Lines and diagnostics of a log, or of all logs below a folder."""
    register(spark)
    reader = spark.read.format("sessionlog").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def records_of(lines: DataFrame) -> DataFrame:
    """Typed records of the source's lines; a log's path is its session key."""
    own = lines.filter("row_kind = 'line' and valid").withColumn("session_key", F.col("path"))
    return typed(own)


@dataclass
class Ledger:
    """A session log, or many: each attribute is a DataFrame that is computed when it is used."""

    records: DataFrame
    lines: DataFrame | None = None
    path: str | None = None

    @cached_property
    def sessions(self) -> DataFrame:
        return graph.sessions(self.records)

    @cached_property
    def stats(self) -> DataFrame:
        return graph.stats(self.records)

    @cached_property
    def type_counts(self) -> DataFrame:
        return graph.type_counts(self.records, graph.KEY)

    @cached_property
    def calls(self) -> DataFrame:
        return graph.calls(self.records)

    @cached_property
    def results(self) -> DataFrame:
        return graph.results(self.records)

    @cached_property
    def turns(self) -> DataFrame:
        return graph.turns(self.records)

    @cached_property
    def steps(self) -> DataFrame:
        return graph.steps(self.records)

    @cached_property
    def messages(self) -> DataFrame:
        return graph.messages(self.records)

    @cached_property
    def usage(self) -> DataFrame:
        return graph.usage_all(self.messages)

    @cached_property
    def assistant_texts(self) -> DataFrame:
        return graph.assistant_texts(self.messages)

    @cached_property
    def user_messages(self) -> DataFrame:
        return graph.user_messages(self.records)

    @cached_property
    def anomalies(self) -> DataFrame:
        return graph.anomalies(self.records)

    @cached_property
    def effects(self) -> DataFrame:
        return graph.effects(self.calls)

    @cached_property
    def effect_summary(self) -> DataFrame:
        return effect_summary(self.effects)

    @cached_property
    def chains(self) -> DataFrame:
        return version_chains(self.effects)

    @cached_property
    def chain_steps(self) -> DataFrame:
        return version_steps(self.effects)

    @cached_property
    def payloads(self) -> DataFrame:
        return payloads(self.records)

    @cached_property
    def diagnostics(self) -> DataFrame:
        if self.lines is None:
            raise ValueError("only a ledger that was read from logs has diagnostics")
        return self.lines.filter("row_kind = 'diagnostic'").select("path", F.col("frame_start").alias("offset"), "kind", "detail", "skipped_bytes")

    def tables(self) -> dict[str, DataFrame]:
        names = ["records", "sessions", "stats", "type_counts", "calls", "results", "turns", "steps", "messages", "usage", "assistant_texts", "user_messages", "anomalies", "effects", "effect_summary", "chains", "chain_steps", "payloads"]
        return {n: getattr(self, n) for n in names}

    def register_views(self, prefix: str = "") -> None:
        """Temporary views of all tables, for SQL."""
        for name, frame in self.tables().items():
            frame.createOrReplaceTempView(prefix + name)


def read_ledger(spark: SparkSession, path: str, persist: bool = True, **options: Any) -> Ledger:
    """The ledger of a log, or of all logs below a folder; its records are parsed once and kept on disk."""
    lines = read_lines(spark, path, **options)
    records = records_of(lines)
    if persist:
        from pyspark import StorageLevel

        records = records.persist(StorageLevel.DISK_ONLY)
    return Ledger(records, lines, path)


def attest(spark: SparkSession, path: str) -> dict[str, Any]:
    """The manifest to publish for a log."""
    return build_manifest(spark, path)


def tail(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A stream of the lines of a growing log, or of all logs below a folder."""
    register(spark)
    reader = spark.readStream.format("sessionlog").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
