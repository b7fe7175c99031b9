"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows and bytes that a Python worker gets at once; the texts of a batch are held in its memory.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    for k, v in BATCHES.items():
        spark.conf.set(k, v)


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the package that has them is a parameter of the queries alone."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .token_files import read_digests, write_tokens

    folder = Scratch(spark, "op1").path
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, folder, manifest)


@query("op10_bpe_digests")
def op10_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op9_substring_dedup", oracles.OP9)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .substrings import substring_digests

    return substring_digests(table(spark, sf_dir, "documents"), Scratch(spark, "op9")).drop("removed_spans")


@query("op5_minhash_neardup", oracles.OP5)
def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates
    from .scratch import Scratch

    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5")).drop("th", "group")


@query("op3_decontaminate", oracles.OP3)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import language_rows

    return language_rows(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rows

    return quality_rows(table(spark, sf_dir, "documents"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), Scratch(spark, "op2"))


@query("op6_embedding_neardup", oracles.OP6)
def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import Scratch
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op6"))
