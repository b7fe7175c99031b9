"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

A stage is a function of (spark, docs, sf_dir). All but the last return the columns of ``documents``, and whatever
other columns there are, under their names. Rows that repeat, null texts and an empty table are stated with each:

1. language: rows whose text has no letter or whose words are of no known language go.
2. near duplicates: one row of each group of near copies stays.
3. substrings: word sequences of 35 and more that stand elsewhere too are taken out of the texts.
4. benchmark: rows with eight consecutive words of a benchmark item, or short items of two and more, go.
5. tokens: the texts' byte-pair ids and what they decode to, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.bpe import bpe_digests
from auditloom.llm.decontaminate import decontaminate
from auditloom.llm.language import keep_identified
from auditloom.llm.near import keep_one
from auditloom.llm.queries import bound_batches, table, tokenizer
from auditloom.llm.scratch import Scratch
from auditloom.llm.substrings import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words' languages are known; see ``keep_identified``.

    Null and empty texts and those without a letter go; repeated rows are judged alike. If no row has a label to
    learn from, all rows with a letter stay.
    """
    bound_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the least doc_id; see ``keep_one``.

    Texts without words, null ones too, are like nothing and stay, every one; of rows that repeat one stays.
    """
    bound_batches(spark)
    return keep_one(docs, Scratch(spark, "pipeline-near"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the word sequences of 35 and more that stand elsewhere too; see ``remove_repeats``.

    A text that loses all words is '', a null text stays null, and a text that loses none stays as it is.
    """
    bound_batches(spark)
    return remove_repeats(docs, Scratch(spark, "pipeline-substrings"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without passages of the table ``benchmark``; see ``decontaminate``.

    Texts are judged as the stage before left them: passages that it took out are in no text any more. Null and
    empty texts stay; with an empty benchmark every row does.
    """
    bound_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256; see ``bpe_digests``. A null text has no ids."""
    bound_batches(spark)
    return bpe_digests(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL has neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
    return docs
