"""Near-duplicate texts by MinHash (operator 5).

1. Texts with equal shingle sets are one class; only classes are compared.
2. A class has ``bands * rows`` minima of universal hash functions; classes that agree on a whole band
   share a bucket. At the similarity asked for, 32 bands of 4 miss a pair once in 200,000.
3. Every member of a bucket is first compared with the bucket's least member alone. Signatures that
   agree in fewer places than any pair at the threshold would (6.5 standard deviations) are dropped,
   the rest confirmed on full sets, and the links' components found.
4. Then, exactly, members of one bucket that are still in different components: in buckets of up to
   ``PAIRS`` members pair by pair; larger buckets are cut into blocks of bounded size, and each pair of
   blocks is one matrix product of its sets that counts all intersections at once and returns only
   links that join components. No pairs are emitted for a large group, none is skipped.
5. Components of all links, by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import sheltered
from .components import components
from .known import release
from .scratch import Scratch
from .words import FIRST, LOWER, SECOND, SPACED, Chunk, chunks, mix, runs, signed, span_hashes

SHINGLE, BANDS, ROWS = 5, 32, 4
#: A link has DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Buckets up to this size are compared pair by pair; blocks of larger ones have about as many members and set bytes.
PAIRS, BLOCK, BLOCK_BYTES = 64, 1024, 4 << 20


def _hash_family(n: int, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other; and where each begins.

    A text of fewer words has all of them as one shingle, a text without words none.
    """
    words = chunk.hashes(FIRST)
    at, hashes = runs(chunk, words, size)
    counts = chunk.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = mix(span_hashes(words, chunk.first[short], chunk.first[short + 1]) + np.uint64(1)) + counts[short].astype(np.uint64)
    begin = np.searchsorted(at, chunk.first)
    sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    for k, x in zip(short.tolist(), whole, strict=True):
        sets[k] = np.array([x], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def minima(flat: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n hash minima of each non-empty set; zeros for an empty one."""
    out = np.zeros((len(offsets) - 1, n), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for k, (a, b) in enumerate(zip(*_hash_family(n), strict=True)):
            out[full, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), offsets[full])
    return out


def _signatures(batches: Iterator[pa.RecordBatch], size: int, n: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for c in chunks(batch.column(2), SPACED, LOWER):
            flat, offsets = shingle_sets(c, size)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat * np.uint64(m)), dtype=np.uint64)])[offsets] for m in (FIRST, SECOND)]
            sign = minima(flat, offsets, n)
            rows = c.rows.stop - c.rows.start
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).slice(c.rows.start, rows), "th": batch.column(1).slice(c.rows.start, rows),
                "f1": signed(np.diff(sums[0])), "f2": signed(np.diff(sums[1])), "n": np.diff(offsets),
                "sign": pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * n), rows, [None, pa.py_buffer(np.ascontiguousarray(sign))]).cast(pa.binary()),
            })


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), SPACED, LOWER):
            flat, offsets = shingle_sets(c, size)
            raw = flat.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), "members": pa.array(sets, pa.binary())})


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (columns 0, 1) whose signatures (2, 3) agree in ``least`` places."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array((a == b).sum(1) >= least))


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (columns 0, 1) whose full sets (2, 3) are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(den * common >= num * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def forest(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Of links u-v between n nodes, some that join all that the links join; labels are joined already."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    for x, y in enumerate(first[inverse].tolist()):
        parent[root(x)] = root(y)
    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            out.append((x, y))
    return out


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each set on the left shares with each on the right."""
    own, other = (np.concatenate(x) for x in (left, right))
    shared = np.intersect1d(own, other)
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.searchsorted(shared, flat)
        known = (column < len(shared)) & (shared[np.minimum(column, max(len(shared) - 1, 0))] == flat) if len(shared) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known]
        column = column[known]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (r1, c1), (r2, c2) = cells(left, own), cells(right, other)
    for at in range(0, len(shared), 4096):
        parts = []
        for r, c, n in ((r1, c1, len(left)), (r2, c2, len(right))):
            a, b = np.searchsorted(c, (at, at + 4096))
            dense = np.zeros((n, min(4096, len(shared) - at)), np.float32)
            dense[r[a:b], c[a:b] - at] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _blocks(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Joining links between two blocks (columns 0 and 1, lists of node, label, members)."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            sides = []
            for side in (x, y):
                items = side.values
                sides.append((items.field(0).to_numpy(), items.field(1).to_numpy(), [np.frombuffer(m.as_buffer(), np.uint64) for m in items.field(2)]))
            (n1, l1, s1), (n2, l2, s2) = sides
            common = intersections(s1, s2).astype(np.int64)
            union = np.array([len(s) for s in s1])[:, None] + np.array([len(s) for s in s2]) - common
            u, v = np.nonzero((den * common >= num * union) & (l1[:, None] != l2))
            nodes, labels = np.concatenate([n1, n2]), np.concatenate([l1, l2])
            found = forest(len(nodes), u, v + len(n1), labels)
            yield pa.RecordBatch.from_pydict({"u": pa.array([nodes[a] for a, _ in found], pa.int64()), "v": pa.array([nodes[b] for _, b in found], pa.int64())})


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = SHINGLE, num: int = NUMERATOR, den: int = DENOMINATOR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept; th (xxhash64 of the text) and group.

    Null and empty texts have an empty set and are linked with nothing: their component is their own
    doc_id, their group null. component_id is the smallest doc_id of the component that isn't null; rows whose doc_id is
    null are compared like others, and are kept only where no row of their component has a doc_id.
    Rows of one doc_id are different documents; all that carry the component's smallest one are kept.
    """
    n = bands * rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = own.select("doc_id", F.xxhash64("text").alias("th"), "text")
    signs = scratch.table(hashed.mapInArrow(lambda it: _signatures(it, size, n), "doc_id long, th long, f1 long, f2 long, n long, sign binary"), "signs")
    grouped = signs.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th", "sign")).alias("one"))
    classes = scratch.table(grouped.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", "first_id", "one.doc_id", "one.th", "one.sign"), "classes")

    each = classes.select("node", "n", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("sign", 4 * rows * b + 1, 4 * rows)) for b in range(bands)])).alias("bucket"))
    counted = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("least"), F.sum("n").alias("total")).filter("m > 1")
    shared = scratch.table(counted.select("bucket", "m", F.col("least.node").alias("root"), F.col("least.n").alias("root_n"), "total"), "shared")
    members = scratch.table(each.join(shared, "bucket"), "members")
    scratch.drop("shared")
    nodes = scratch.table(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "n", "doc_id", "th", "sign"), "nodes")
    # By text and doc_id: copies of one text are many, rows that have both in common are not.
    same = (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = hashed.join(nodes.select("node", F.col("th").alias("_th"), F.col("doc_id").alias("_id")), same).select("node", "text")
    sets = scratch.table(texts.mapInArrow(lambda it: _sets(it, size), "node long, members binary").groupBy("node").agg(F.first("members").alias("members")), "sets")

    # How many places of two signatures agree at the threshold, less 6.5 standard deviations.
    t = num / den
    least = max(1, int(n * t - 6.5 * (n * t * (1 - t)) ** 0.5))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(x), F.col("sign").alias(f"sign_{x}")) for x in "uv")
        likely = pairs.join(a, "u").join(b, "v").select("u", "v", "sign_u", "sign_v").mapInArrow(lambda it: _agreeing(it, least), "u long, v long")
        a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}")) for x in "uv")
        return likely.join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v").mapInArrow(lambda it: _linked(it, num, den), "u long, v long")

    fits = F.lit(den) * F.least("n", "root_n") >= F.lit(num) * F.greatest("n", "root_n")
    star = members.filter("node <> root").filter(fits).select("root", "node").distinct()
    star_links = scratch.table(confirmed(star.select(F.col("root").alias("u"), F.col("node").alias("v"))), "star")
    near = components(star_links, scratch, "near")

    labelled = members.join(near, "node", "left").select("bucket", "m", "total", "node", "n", F.coalesce("component", "node").alias("label"))
    open_buckets = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    rest = scratch.table(labelled.join(open_buckets, "bucket", "left_semi"), "open")
    small = rest.filter(F.col("m") <= PAIRS)
    a = small.select("bucket", F.col("node").alias("u"), F.col("label").alias("label_u"), F.col("n").alias("root_n"))
    b = small.select("bucket", F.col("node").alias("v"), F.col("label").alias("label_v"), "n")
    pairs = a.join(b, "bucket").filter("u < v and label_u <> label_v").filter(fits).select("u", "v").distinct()

    n_blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES))
    large = rest.filter(F.col("m") > PAIRS).withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    packed = scratch.table(large.join(sets, "node").groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "label", "members")).alias("items")), "blocks")
    left, right = (packed.select("bucket", F.col("block").alias(f"{x}_block"), F.col("items").alias(f"{x}_items")) for x in ("a", "b"))
    tiles = left.join(right, "bucket").filter("a_block <= b_block").select("a_items", "b_items")
    more = confirmed(pairs).union(tiles.mapInArrow(lambda it: _blocks(it, num, den), "u long, v long"))

    lab = near.select(F.col("node").alias("u"), F.col("component").alias("lu")), near.select(F.col("node").alias("v"), F.col("component").alias("lv"))
    joins = more.join(lab[0], "u", "left").join(lab[1], "v", "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
    far = components(joins, scratch, "far").toDF("label", "component")
    placed = classes.select("node", "f1", "f2", "n", "first_id").join(near.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = scratch.table(placed.join(far, "label", "left").select("f1", "f2", "n", "first_id", F.coalesce("component", "label").alias("component")), "placed")
    # Written, so that the join with a component of very many classes can be split.
    named = scratch.table(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "named")
    by_class = placed.join(named, "component").select("f1", "f2", "n", "component_id", F.col("component").alias("group"))
    component_id = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    out = signs.select("doc_id", "th", "f1", "f2", "n").join(by_class, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component_id, "th", "group")
    out = scratch.table(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")
    scratch.drop("signs", "classes", "members", "nodes", "sets", "star", "open", "blocks", "placed", "named")
    return out


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each group the one with the least doc_id.

    A null doc_id comes last; of rows with the same doc_id the one with the least text hash stays, and one
    only of rows that repeat. Rows without words are linked with nothing and stay.
    """
    docs, restored = sheltered(docs, "doc_id", "text")
    found = near_duplicates(docs, scratch).filter("group is not null")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("one"))
    wanted = first.select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = docs.filter(worded).withColumns({"_id0": F.col("doc_id").cast("long"), "_th0": F.xxhash64(F.col("text").cast("string"))})
    kept = hashed.join(wanted, F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_th0") == F.col("_th"))).dropDuplicates(["_id0", "_th0"]).select(*docs.columns)
    return restored(kept.unionByName(docs.filter(~worded)))
