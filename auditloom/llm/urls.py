"""URL filters (operator 2): rules, and gradient-boosted trees where no rule fits.

Everything here is DataFrame and SQL functions. The trees learn from the URLs that rules decide. Their
features are lexical: lengths, depth, digit ratio, entropy, parameter counts and how often the host's
suffix was blocked. A level of a tree is one aggregation: the labelled rows' gradients are summed by
node, feature and bin, a few thousand sums whatever the number of rows, and the driver picks the splits
from them. The finished trees are CASE expressions inside the scan's generated code.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.4, 1.0
#: Labelled URLs that the trees learn from at most, those with the least hash; suffix statistics count all of them.
SAMPLE = 500_000
#: Parts that labelled URLs are dealt into; a URL's suffix rate comes from the other parts.
FOLDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first '://', A-Z lower-cased; path: up to '?', '#' or the end. Both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, f"{h}{p}").otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def _entropy(s: Column) -> Column:
    """Bits for each character of a string's own distribution."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = F.transform(F.array_distinct(F.split(s, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise((F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(c) / n))
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _count(s: Column, characters: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, characters, ""))).cast("double")


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"), "dots": _count(host, "."), "hyphens": _count(url, "-"), "digits": _count(url, "0123456789") / size,
        "entropy": _entropy(url), "parameters": _count(url, "=") + _count(url, "&"), "marks": _count(url, "?#%"), "host_digits": _count(host, "0123456789"),
    }


class Split(NamedTuple):
    feature: str
    threshold: float
    low: object  # Split or a leaf's value
    high: object


class Trees(NamedTuple):
    base: float
    trees: list[object]

    def margin(self) -> Column:
        """The sum of all trees as one expression of the feature columns."""
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _expression(tree)
        return out

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))


def _expression(node: object) -> Column:
    if isinstance(node, Split):
        return F.when(F.col(node.feature) <= node.threshold, _expression(node.low)).otherwise(_expression(node.high))
    return F.lit(float(node))


def _leaf_number(node: object, at: list[int]) -> Column:
    """Which leaf of a growing tree a row is in."""
    if isinstance(node, Split):
        low = _leaf_number(node.low, at)
        return F.when(F.col(node.feature) <= node.threshold, low).otherwise(_leaf_number(node.high, at))
    at.append(len(at))
    return F.lit(at[-1])


def _grow(node: object, leaves: list[object]) -> object:
    if isinstance(node, Split):
        return Split(node.feature, node.threshold, _grow(node.low, leaves), _grow(node.high, leaves))
    return leaves.pop(0)


def boost(rows: DataFrame, names: list[str], label: str, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Trees from a written table of features (double) and a label of 0 and 1 by second-order boosting."""
    cuts = [k / bins for k in range(1, bins)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("mean"), *[F.percentile_approx(x, cuts, 2000).alias(x) for x in names]).first()
    if not found.n or found["mean"] in (0.0, 1.0):
        return Trees(0.0 if not found.n else math.copysign(6.0, found["mean"] - 0.5), [])
    edges = {x: sorted(set(found[x])) for x in names}
    model = Trees(math.log(found["mean"] / (1 - found["mean"])), [])

    def number(name: str) -> Column:
        """The number of a value's bin: how many edges it is above."""
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[name]]), lambda e: e < F.col(name)))

    binned = F.array(*[number(x) for x in names])
    for _ in range(trees):
        p = model.probability()
        staged = rows.withColumn("_g", F.col(label) - p).withColumn("_h", p * (1 - p)).withColumn("_bins", binned)
        tree: object = 0.0
        for level in range(depth + 1):
            leaf = _leaf_number(tree, [])
            sums = staged.select(leaf.alias("leaf"), "_g", "_h", F.posexplode("_bins").alias("feature", "bin")).groupBy("leaf", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
            by: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for r in sums.collect():
                by.setdefault(r.leaf, {}).setdefault(r.feature, {})[r.bin] = (r.g, r.h)
            leaves, split = [], False
            for k in range(max(by) + 1):
                node = by.get(k, {})
                g, h = (math.fsum(v[i] for v in node.get(0, {}).values()) for i in (0, 1))
                best = _best(node, names, edges, g, h) if level < depth else None
                value = RATE * g / (h + RIDGE)
                leaves.append(Split(*best, value, value) if best else value)
                split |= bool(best)
            tree = _grow(tree, leaves)
            if not split:
                break
        model.trees.append(tree)
    return model


def _best(node: dict, names: list[str], edges: dict[str, list[float]], g: float, h: float) -> tuple[str, float] | None:
    """The split with the largest gain of a node, None if none gains."""
    best, gain = None, 1e-6
    for f, name in enumerate(names):
        left_g = left_h = 0.0
        for b, edge in enumerate(edges[name]):
            dg, dh = node.get(f, {}).get(b, (0.0, 0.0))
            left_g, left_h = left_g + dg, left_h + dh
            right_g, right_h = g - left_g, h - left_h
            if left_h < 1e-3 or right_h < 1e-3:
                continue
            now = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g**2 / (h + RIDGE)
            if now > gain * (1 + 1e-9):
                best, gain = (name, edge), now
    return best


def judge_urls(pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, block_from: float = 0.5, learn_from: Column | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, block_score.

    A null url, or one without '://', has an empty host and path; no rule fits it unless one has both
    empty. Without labelled URLs the trees say allow. Repeated rows are judged alike and are one URL to learn from,
    whose suffix's rate is that of other folds; an empty table gives no row. ``learn_from``, a condition over
    url, holds labelled URLs back from all learning.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).withColumn("host", host).withColumn("path", path)
    text, verdict = rule_column(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", text).withColumn("ruled", verdict).withColumn("suffix", suffix_of(F.col("host")))
    labelled = parsed.filter(F.col("ruled").isNotNull() & (F.lit(True) if learn_from is None else learn_from))
    blocked = F.sum((F.col("ruled") == "block").cast("double"))
    urls = labelled.groupBy("url", "host", "path", "suffix").agg(F.count(F.lit(1)).cast("double").alias("url_n"), blocked.alias("url_b"))
    urls = scratch.table(urls.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))), "urls")
    # What a URL learns from is its suffix's rate in all other folds: without its fold, not just without itself,
    # as a rate that lacks one's own label alone gives that label away.
    folds = urls.groupBy("suffix", "fold").agg(F.sum("url_n").alias("own_n"), F.sum("url_b").alias("own_b"))
    suffixes = scratch.table(folds.groupBy("suffix").agg(F.sum("own_n").alias("n"), F.sum("own_b").alias("b")), "suffixes")
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    names = [*features, "suffix_rate", "suffix_count"]

    def with_features(frame: DataFrame, own_n: Column, own_b: Column) -> DataFrame:
        """How often a suffix was blocked elsewhere, shrunk towards one half, beside the lexical features."""
        n, b = (F.coalesce(c, F.lit(0.0)) - own for c, own in ((F.col("n"), own_n), (F.col("b"), own_b)))
        return frame.join(suffixes, "suffix", "left").withColumns({**features, "suffix_rate": (b + 2.0) / (n + 4.0), "suffix_count": F.log1p(n)})

    count = urls.count()
    share = int(min(1.0, sample / max(count, 1)) * 1_000_000)
    some = with_features(urls.filter(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1_000_000)) < share).join(folds, ["suffix", "fold"]), F.col("own_n"), F.col("own_b"))
    rows = scratch.table(some.select((F.col("url_b") / F.col("url_n")).alias("label"), *names), "labelled")
    model = boost(rows, names, "label")
    scratch.drop("labelled", "urls")
    scored = with_features(parsed, F.lit(0.0), F.lit(0.0)).withColumn("block_score", model.probability() if count else F.lit(0.0))
    method = F.when(F.col("block_score") >= block_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_score")
