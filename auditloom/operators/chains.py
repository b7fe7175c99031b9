"""Histories of files: what was read, written and edited, and whether a shell may have interfered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, AT = "session_key", "record_index"
#: Sequence numbers of a bucket of the shell index.
SPAN = 4096


def version_steps(effects: DataFrame) -> DataFrame:
    """The reads, writes and edits of each path, oldest first by ``position``."""
    steps = effects.filter(F.col("kind").isin("read", "write", "edit") & (F.col("path") != ""))
    order = Window.partitionBy(KEY, "path").orderBy(F.coalesce("seq", "time"), AT)
    return steps.select(KEY, "path", F.row_number().over(order).alias("position"), "seq", "time", "call_id", "tool_name", "kind", "fidelity", "content_hash", "bytes", "detail")


def _shell_buckets(effects: DataFrame) -> DataFrame:
    """Shell effects by bucket of sequence numbers: each number's count, and the bucket's total.

    A bucket has at most SPAN different numbers, so its list is bounded however many shells ran.
    """
    by_seq = effects.filter("kind = 'shell' and seq is not null").groupBy(KEY, "seq").agg(F.count(F.lit(1)).alias("n"))
    return by_seq.groupBy(KEY, F.floor(F.col("seq") / SPAN).alias("bucket")).agg(F.collect_list(F.struct("seq", "n")).alias("own"), F.sum("n").alias("total"))


def _shells_upto(ends: DataFrame, buckets: DataFrame, seq: str, name: str, inclusive: bool) -> DataFrame:
    """``ends`` with the number of shells up to a sequence number.

    Every bucket that an end falls in gets a row of its own, with the shells before it as a running sum over a
    session's buckets; ends then meet their bucket by equality.
    """
    placed = ends.withColumn("bucket", F.floor(F.col(seq) / SPAN))
    every = buckets.join(placed.select(KEY, "bucket").distinct(), [KEY, "bucket"], "full")
    before = F.sum("total").over(Window.partitionBy(KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counted = every.select(KEY, "bucket", "own", F.coalesce(before, F.lit(0)).alias("before"))

    def upto(x: Column) -> Column:
        return (x.seq <= F.col(seq)) if inclusive else (x.seq < F.col(seq))

    n = F.col("before") + F.coalesce(F.aggregate(F.filter("own", upto), F.lit(0).cast("long"), lambda a, x: a + x.n), F.lit(0))
    return placed.join(counted, [KEY, "bucket"], "left").withColumn(name, F.coalesce(n, F.lit(0).cast("long"))).drop("bucket", "own", "before")


def version_chains(effects: DataFrame) -> DataFrame:
    """Per path: steps, created, preexisting, last_exact_hash, shells_in_window and contaminated.

    The window reaches from the path's least to its greatest sequence number. Shells in it are the
    difference of two counts up to a number, so no effect is compared with all shells.
    """
    touched = effects.filter(F.col("kind").isin("read", "write", "edit") & (F.col("path") != ""))
    order = F.struct(F.coalesce("seq", "time"), F.col(AT))
    exact = (F.col("kind") == "write") & (F.col("fidelity") == "exact")
    chains = touched.groupBy(KEY, "path").agg(
        F.count(F.lit(1)).alias("steps"), F.min_by(F.struct("kind", "fidelity"), order).alias("first"), F.max_by("content_hash", F.when(exact, order)).alias("last_exact_hash"),
        F.min("seq").alias("low"), F.max("seq").alias("high"),
    )
    buckets = _shell_buckets(effects)
    counted = _shells_upto(_shells_upto(chains, buckets, "low", "before_low", False), buckets, "high", "upto_high", True)
    shells = F.when(F.col("low").isNull(), F.lit(0).cast("long")).otherwise(F.col("upto_high") - F.col("before_low"))
    first = F.col("first.kind")
    return counted.select(
        KEY, "path", "steps", ((first == "write") & (F.col("first.fidelity") == "exact")).alias("created"), first.isin("read", "edit").alias("preexisting"), "last_exact_hash",
        shells.alias("shells_in_window"), (shells > 0).alias("contaminated"),
    )
