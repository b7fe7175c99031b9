"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


#: A node's edges are dealt into so many parts, so that no task gets all edges of a node with very many.
PARTS = 1024


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of all edges of u.

    The least is taken of each part of a node's edges, then of its parts, and goes back to the parts that there are.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int"))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("part").alias("parts")).select("u", F.explode("parts").alias("part"), "m")
    return dealt.join(least, ["u", "part"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    # Of a node's edges that to the least one gives itself.
    out = down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Each node of ``edges`` (u, v, both long) with its component's least node: node, component.

    Only nodes that have an edge to another are listed. A step sends at most two rows for each edge; a
    node's neighbours are never gathered, only their least is taken, with partial sums on the way. Each
    round is written to the shared folder. The rounds grow with the logarithm of the longest path.
    """
    now, last, k = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}0"), None, 0
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == last:
            break
        last = (seen.n, seen.h)
        large = _large_star(now)
        now = scratch.table(_small_star(large), f"{label}{k + 1}")
        scratch.drop(f"{label}{k}")
        k += 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
