"""Removal of long repeated word sequences (operator 9), by De Bruijn compaction.

Edges are the runs of k words, nodes the runs of k - 1 words at their ends; what is wanted are the edges
that occur twice.

1. Equal texts are one text with a count. A text's neighbouring nodes that have one minimizer, the least of
   their runs of m words by hash, are a strand; it owns the edges that leave them. All occurrences of a
   node have its minimizer, so strands whose minimizer occurs once are left out, and where all strands of
   a minimizer are equal, with the words before and behind them, no node inside has a second edge.
2. One copy of each different strand is read from its source coordinates: one of a minimizer that has no
   other becomes one compacted edge, others are expanded into edges. These are counted by 128-bit hashes,
   with the weight of their strands; those counted twice are the graph.
3. In- and out-degrees of the nodes are counted. Edges that follow each other through a node with one
   edge in and one out are a piece; pieces are compacted into nonbranching paths by joins of end node with
   begin node and pointer doubling: each round of joins doubles the pieces that are put together.
4. Every place of a strand is projected onto the paths: stretches of a text that run along one path. A
   stretch is compared word by word with the words of its path, which come from the source coordinates of
   the path's pieces; a stretch whose words differ stays. All words of the others go.

No step gathers a group of places: they are counted with partial sums or joined, and a join with a frequent
strand or path is split by adaptive execution. Lists are bounded by a text, a strand (k edges) or a block
of a path (``BLOCK`` edges).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import sheltered
from .known import release
from .scratch import Scratch
from .words import AS_IS, FIRST, SECOND, SPACED, Chunk, chunks, joined, mix, run_hashes, signed, span_hashes, string_array

WINDOW, MINIMIZER = 35, 16
#: Edges of a path that are compared with texts as one.
BLOCK = 256
_KEY = ["t1", "t2"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _words_digests(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The texts' words with one space between, as bytes and offsets, and SHA-256 of each text's."""
    data, offsets = joined(chunk)
    view = memoryview(data)
    return data, offsets, [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _fingerprints(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each digest."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(len(digests), -1)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(1), SPACED, AS_IS):
            digests = _words_digests(c)[2]
            t1, t2 = _fingerprints(digests)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), "t1": t1, "t2": t2, "n_words": c.counts, "sha": [d.hex() for d in digests]})


def _long_texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for c in chunks(batch.column(0), SPACED, AS_IS):
            data, offsets, digests = _words_digests(c)
            t1, t2 = _fingerprints(digests)
            yield pa.RecordBatch.from_pydict({"t1": t1, "t2": t2, "words": string_array(data, offsets)}).filter(pa.array(c.counts >= k))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        x = np.minimum(x[:-length], x[length:])
        length *= 2
    return np.minimum(x[: len(x) - (width - length)], x[width - length :])


def strands(chunk: Chunk, h1: np.ndarray, h2: np.ndarray, k: int, m: int) -> dict[str, np.ndarray]:
    """The strands of a chunk's texts: minimizer, hashes, text, first node (a word of the text), number of edges owned.

    The hashes are of all words of the strand's edges, the one into its first node included, and tell a text's ends.
    """
    n, width = len(h1), k - 1
    start = np.arange(n - width + 1) if n >= width else np.zeros(0, np.int64)
    start = start[start + width <= chunk.last()[: len(start)]]
    if not len(start):
        none = np.zeros(0, np.int64)
        return {"m": none, "s1": none, "s2": none, "text": none, "at": none, "n": none}
    grams = run_hashes(h1, m)
    # The upper half orders, the place decides ties: the leftmost.
    least = _sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams)).astype(np.uint64), width - m + 1) & np.uint64(0xFFFFFFFF)
    place = least[start].astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    a, nodes = start[turn], np.diff(np.concatenate([turn, [len(place)]]))
    text = np.searchsorted(chunk.first, a, "right") - 1
    before, stop = np.maximum(a - 1, chunk.first[text]), a + nodes + width
    end = np.minimum(stop, chunk.first[text + 1])
    ends = (before == a).astype(np.uint64) + np.uint64(2) * (end < stop)
    return {
        "m": grams[place[turn]], "s1": mix(span_hashes(h1, before, end, FIRST) + ends), "s2": mix(span_hashes(h2, before, end, SECOND) + ends),
        "text": text, "at": a - chunk.first[text], "n": end - a - width,
    }


def _strands(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tid, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        for c in chunks(batch.column(2), SPACED, AS_IS):
            p = strands(c, c.hashes(FIRST), c.hashes(SECOND), k, m)
            row = p["text"] + c.rows.start
            yield pa.RecordBatch.from_pydict({"m": signed(p["m"]), "s1": signed(p["s1"]), "s2": signed(p["s2"]), "tid": tid[row], "copies": copies[row], "at": pa.array(p["at"], pa.int32()), "n": pa.array(p["n"], pa.int32())})


def _lists(column: pa.Array, rows: slice) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of a column of lists of structs: the row of each element, counted from rows.start, and its fields."""
    own = column.slice(rows.start, rows.stop - rows.start)
    items = own.flatten()
    counts = np.diff(own.offsets.to_numpy())
    return np.repeat(np.arange(len(own)), counts), {f.name: items.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(items.type)}


def _edges(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The edges of listed strands with their nodes; a strand that is alone is one edge of several.

    An edge's ``home`` is k times its strand plus its place in the strand; the first one carries the strand's words.
    """
    for batch in batches:
        for c in chunks(batch.column(0), SPACED, AS_IS):
            row, f = _lists(batch.column(1), c.rows)
            h1, h2 = c.hashes(FIRST), c.hashes(SECOND)
            e1, e2, nodes, raw = signed(run_hashes(h1, k)), signed(run_hashes(h2, k, SECOND)), signed(run_hashes(h1, k - 1)), c.data.tobytes()
            # A few strands of a text at a time: all of a long text's edges would be many rows.
            for at in range(0, len(row), 20_000):
                sid, n, weight, alone = (f[name][at : at + 20_000] for name in ("sid", "n", "weight", "alone"))
                alone, n = alone.astype(bool), n.astype(np.int64)
                first, some = c.first[row[at : at + 20_000]] + f["at"][at : at + 20_000], np.where(alone, np.minimum(n, 1), n)
                inside, whole = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some), np.repeat(alone, some)
                edge, own, size = np.repeat(first, some) + inside, np.repeat(sid, some), np.where(whole, np.repeat(n, some), 1)
                words = np.full(len(edge), None, object)
                words[inside == 0] = [raw[a:b].decode() for a, b in zip(c.start[first[some > 0]].tolist(), c.end[(first + n + k - 2)[some > 0]].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "e1": np.where(whole, own, e1[edge]), "e2": np.where(whole, -1, e2[edge]), "u": nodes[edge], "v": nodes[edge + size],
                    "home": own * k + inside, "n": pa.array(size, pa.int32()), "weight": np.repeat(weight, some), "words": pa.array(words, pa.string()),
                })


def _verified(c: Chunk, first: np.ndarray, n: np.ndarray, skip: np.ndarray, paths: pa.Array) -> np.ndarray:
    """Whether the n words from each place of the chunk are those of the path's words from ``skip`` on."""
    (p,) = chunks(paths, SPACED, AS_IS, limit=1 << 62)
    other = p.first[:-1] + skip
    a, b = c.start[first], p.start[other]
    size = c.end[first + n - 1] - a
    same = size == p.end[other + n - 1] - b
    some = np.flatnonzero(same)
    offsets = np.concatenate([[0], np.cumsum(size[some])])
    step = np.arange(offsets[-1])
    differ = np.flatnonzero(c.data[np.repeat(a[some] - offsets[:-1], size[some]) + step] != p.data[np.repeat(b[some] - offsets[:-1], size[some]) + step])
    same[some[np.searchsorted(offsets, differ, "right") - 1]] = False
    return same


def _kept(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What is left of texts (t1, t2, words) without the listed stretches that have the words of their path."""
    for batch in batches:
        for c in chunks(batch.column(2), SPACED, AS_IS):
            n = c.rows.stop - c.rows.start
            listed = batch.column(3).slice(c.rows.start, n)
            row = np.repeat(np.arange(n), np.diff(listed.offsets.to_numpy()))
            at, count, skip, paths = listed.flatten().flatten()
            first, size = c.first[row] + at.to_numpy(), count.to_numpy() + k - 1
            good = _verified(c, first, size, skip.to_numpy(), paths)
            cover = np.zeros(len(c.start) + 1, np.int64)
            np.add.at(cover, first[good], 1)
            np.subtract.at(cover, first[good] + size[good], 1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = string_array(*joined(c, ~gone))
            removed = np.concatenate([[0], np.cumsum(gone)])
            edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            # Spans don't cross texts: cut where a text begins.
            inner = np.zeros(len(gone) + 1, bool)
            inner[c.first] = True
            both = np.zeros(len(gone) + 1, bool)
            both[1:-1] = gone[1:] & gone[:-1]
            begin, end = (np.flatnonzero((edge == sign) | (inner & both)) for sign in (1, -1))
            text = np.searchsorted(c.first, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - c.first[text], pa.int32()), pa.array(end - c.first[text], pa.int32())], ["first", "stop"])
            sha = [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer() is not None else _EMPTY for x in kept.cast(pa.binary())]
            yield pa.RecordBatch.from_pydict({
                "t1": batch.column(0).slice(c.rows.start, n), "t2": batch.column(1).slice(c.rows.start, n),
                "n_removed": np.diff(removed[c.first]), "kept_sha256": sha, "kept": kept,
                "spans": pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), spans),
            })


def _stretches(frame: DataFrame, group: str, at: str) -> DataFrame:
    """Rows of a group (``at``, ``n`` edges, path, off) that continue each other along a path, put together."""
    order = Window.partitionBy(group).orderBy(at)
    ends = F.struct(F.col(at) + F.col("n"), "path", F.col("off") + F.col("n"))
    fresh = F.coalesce(F.lag(ends).over(order) != F.struct(F.col(at), "path", "off"), F.lit(True))
    numbered = frame.withColumn("_fresh", fresh.cast("long")).withColumn("_run", F.sum("_fresh").over(order))
    return numbered.groupBy(group, "_run").agg(F.min(at).alias("at"), F.sum("n").cast("int").alias("n"), F.first("path").alias("path"), F.min("off").alias("off")).drop("_run")


def compacted(edges: DataFrame, scratch: Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """The nonbranching paths of a graph with edges (e1, e2, home, u, v, n: how many edges it stands for).

    Returns the edges with their pieces (e1, e2, piece, i: the edge's place in it) and the pieces with
    their place in a path (piece, n, path, off). A piece's id is the home of its first edge, a path's id its
    first piece. Pieces of a circle, which has no beginning, are paths by themselves.
    """
    # One edge in, one edge out: the node is inside a path.
    ends = edges.selectExpr("stack(2, u, 1, 0, v, 0, 1) as (node, outs, ins)").groupBy("node").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    inner = ends.filter("outs = 1 and ins = 1").select(F.col("node").alias("u"), F.lit(True).alias("inner"))
    flagged = edges.join(inner, "u", "left").withColumn("strand", F.expr(f"home div {k}"))
    order = Window.partitionBy("strand").orderBy("home")
    begins = F.col("inner").isNull() | F.coalesce(F.lag("home").over(order) != F.col("home") - 1, F.lit(True))
    pieced = flagged.withColumn("piece", F.when(begins, F.col("home"))).withColumn("piece", F.last("piece", True).over(order))
    pieced = scratch.table(pieced.select("e1", "e2", "piece", (F.col("home") - F.col("piece")).cast("int").alias("i"), "u", "v", "n", "inner"), "pieced")
    pieces = pieced.groupBy("piece").agg(F.sum("n").alias("n"), F.min(F.struct("i", "u", "inner")).alias("head"), F.max(F.struct("i", "v")).alias("tail"))
    pieces = scratch.table(pieces.select("piece", "n", "head.u", "head.inner", "tail.v"), "pieces")

    # A piece's predecessor ends where it begins; pointers are doubled until all reach a path's first piece.
    before = pieces.select(F.col("piece").alias("ptr"), F.col("n").alias("dist"), F.col("v").alias("u"))
    after = pieces.filter("inner").select("piece", "u").join(before, "u").select("piece", "ptr", "dist")
    first = pieces.select("piece").join(after, "piece", "left")
    state = scratch.table(first.select("piece", F.coalesce("ptr", "piece").alias("ptr"), F.coalesce("dist", F.lit(0)).alias("dist"), F.col("ptr").isNull().alias("done")), "chain0")
    left, step = state.filter("not done").count(), 0
    while left:
        ahead = state.select(F.col("piece").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = state.filter("not done").join(ahead, "ptr").select("piece", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        state = scratch.table(state.filter("done").unionByName(moved), f"chain{step + 1}")
        scratch.drop(f"chain{step}")
        step += 1
        now = state.filter("not done").count()
        if now == left:  # only circles are left
            break
        left = now
    placed = pieces.select("piece", "n").join(state, "piece")
    return pieced.select("e1", "e2", "piece", "i"), placed.select("piece", "n", F.when(F.col("done"), F.col("ptr")).otherwise(F.col("piece")).alias("path"), F.when(F.col("done"), F.col("dist")).otherwise(0).alias("off"))


def repeated(docs: DataFrame, scratch: Scratch, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """One row for each distinct sequence of words of ``docs.text`` that has a repeated window.

    Columns: t1, t2 (the sequence's fingerprint), copies, n_removed, kept_sha256, kept (the words left,
    one space between), spans (first and stop word of each removed stretch).
    """
    long_texts = docs.select("text").mapInArrow(lambda it: _long_texts(it, k), "t1 long, t2 long, words string")
    texts = long_texts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    texts = scratch.table(texts.select(F.monotonically_increasing_id().alias("tid"), *_KEY, "copies", "words"), "texts", "zstd")

    # Strands whose minimizer occurs more than once, and one source of each different one.
    found = texts.select("tid", "copies", "words").mapInArrow(lambda it: _strands(it, k, min(m, k // 2)), "m long, s1 long, s2 long, tid long, copies long, at int, n int")
    often = scratch.table(found.groupBy("m").agg(F.sum("copies").alias("total")).filter("total > 1").select("m"), "often")
    places = scratch.table(found.join(often, "m", "left_semi"), "places")
    scratch.drop("often")
    sources = places.groupBy("s1", "s2").agg(F.first("m").alias("m"), F.sum("copies").alias("weight"), F.min(F.struct("tid", "at", "n")).alias("source"))
    sources = scratch.table(sources.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "m", "weight", "source"), "sources")

    # Their edges; those that occur more than once are the graph.
    alone = sources.groupBy("m").agg(F.count(F.lit(1)).alias("strands"), F.min("sid").alias("sid")).filter("strands = 1").select("sid", F.lit(1).alias("alone"))
    mine = sources.filter("source.n > 0").join(alone, "sid", "left")
    wanted = mine.groupBy("source.tid").agg(F.collect_list(F.struct("sid", "source.at", "source.n", "weight", F.coalesce("alone", F.lit(0)).alias("alone"))).alias("strands"))
    edges = texts.select("tid", "words").join(wanted, "tid").select("words", "strands").mapInArrow(lambda it: _edges(it, k), "e1 long, e2 long, u long, v long, home long, n int, weight long, words string")
    edges = scratch.table(edges, "edges", "zstd")
    graph = edges.groupBy("e1", "e2").agg(F.sum("weight").alias("total"), F.min("home").alias("home"), F.first("u").alias("u"), F.first("v").alias("v"), F.first("n").alias("n")).filter("total > 1").drop("total")
    pieced, pieces = compacted(scratch.table(graph, "graph"), scratch, k)
    pieces = scratch.table(pieces, "placed")
    scratch.drop("graph")

    # Where each strand runs along which path, and so each of its places.
    along = edges.select("e1", "e2", "home", "n").join(pieced, ["e1", "e2"]).select("home", "n", "piece", "i").join(pieces.select("piece", "path", "off"), "piece")
    along = along.select(F.expr(f"home div {k}").alias("sid"), F.expr(f"cast(home % {k} as int)").alias("rel"), "n", "path", (F.col("off") + F.col("i")).alias("off"))
    runs = _stretches(along, "sid", "rel").groupBy("sid").agg(F.collect_list(F.struct("at", "n", "path", "off")).alias("runs"))
    runs = scratch.table(sources.select("sid", "s1", "s2").join(runs, "sid").drop("sid"), "runs")
    marks = places.filter("copies = 1").select("s1", "s2", "tid", F.col("at").alias("begin")).join(runs, ["s1", "s2"]).select("tid", "begin", F.explode("runs").alias("r"))
    marks = marks.select("tid", (F.col("begin") + F.col("r.at")).alias("at"), "r.n", "r.path", "r.off")

    # Paths in blocks, with their words from the sources of their pieces.
    lead = edges.filter("words is not null").select(F.expr(f"home div {k}").alias("sid"), "words")
    own = pieces.withColumn("sid", F.expr(f"piece div {k}")).join(lead, "sid").withColumn("ws", F.slice(F.split("words", " "), F.expr(f"cast(piece % {k} as int) + 1"), F.expr(f"cast(n as int) + {k - 1}")))
    cut = F.sequence(F.expr(f"off div {BLOCK}"), F.expr(f"(off + n - 1) div {BLOCK}"))
    blocks = own.select("path", F.explode(cut).alias("block"), F.struct("off", "n", "ws").alias("p")).groupBy("path", "block").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    joined_words = F.expr(f"array_join(concat(flatten(transform(ps, p -> slice(p.ws, 1, cast(p.n as int)))), slice(element_at(ps, -1).ws, cast(element_at(ps, -1).n as int) + 1, {k - 1})), ' ')")
    blocks = scratch.table(blocks.select("path", "block", F.expr("ps[0].off").alias("base"), joined_words.alias("path_words")), "blocks")
    scratch.drop("edges", "pieced", "pieces", "placed")

    long = scratch.table(_stretches(marks, "tid", "at"), "long")
    scratch.drop("places", "sources", "runs")
    long = long.withColumn("block", F.explode(cut))
    begin, end = F.greatest(F.col("off"), F.col("block") * BLOCK), F.least(F.col("off") + F.col("n"), (F.col("block") + 1) * BLOCK)
    long = long.select("tid", (F.col("at") + begin - F.col("off")).cast("int").alias("at"), (end - begin).cast("int").alias("n"), begin.alias("off"), "path", "block")
    listed = long.join(blocks, ["path", "block"]).groupBy("tid").agg(F.collect_list(F.struct("at", "n", (F.col("off") - F.col("base")).cast("int").alias("skip"), "path_words")).alias("stretches"))
    one = texts.filter("copies = 1").select("tid", *_KEY, "words").join(listed, "tid").select(*_KEY, "words", "stretches")
    once = one.mapInArrow(lambda it: _kept(it, k), "t1 long, t2 long, n_removed long, kept_sha256 string, kept string, spans array<struct<first:int,stop:int>>")
    n_words = (F.length("words") - F.length(F.translate("words", " ", "")) + 1).cast("long")
    spans = F.array(F.struct(F.lit(0).alias("first"), n_words.cast("int").alias("stop")))
    copied = texts.filter("copies > 1").select("t1", "t2", n_words.alias("n_removed"), F.lit(_EMPTY).alias("kept_sha256"), F.lit("").alias("kept"), spans.alias("spans"))
    out = scratch.table(once.unionByName(copied), "repeated")
    scratch.drop("texts", "blocks", "long")
    return out


def substring_digests(docs: DataFrame, scratch: Scratch, k: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and the removed spans.

    A null text has no words, an empty one neither; texts of fewer than k words lose nothing. Rows that
    repeat, also with one doc_id or none, count as different documents with equal words. An empty table
    gives no row, and other columns of ``docs`` are left out, whatever their names.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated(own, scratch, k).select("t1", "t2", "n_removed", "kept_sha256", "spans")
    plain = own.mapInArrow(_digest, "doc_id long, t1 long, t2 long, n_words long, sha string")
    none = F.array().cast("array<struct<first:int,stop:int>>")
    return plain.join(gone, _KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", none).alias("removed_spans")
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(batch.schema.get_field_index("text")), SPACED, AS_IS):
            t1, t2 = _fingerprints(_words_digests(c)[2])
            yield pa.RecordBatch.from_arrays([*(x.slice(c.rows.start, c.rows.stop - c.rows.start) for x in batch.columns), pa.array(t1), pa.array(t2)], names=[*batch.schema.names, "_t1", "_t2"])


def remove_repeats(docs: DataFrame, scratch: Scratch, k: int = WINDOW) -> DataFrame:
    """``docs``, all rows and columns, with repeated stretches taken out of the texts.

    A text that loses words has those left with one space between, '' if none is; others stay as
    they are. n_chars, where there is such a column, is the length of the new text.
    """
    docs, restored = sheltered(docs, "text", "n_chars")
    own = docs.withColumn("text", F.col("text").cast("string"))
    gone = repeated(own, scratch, k).filter("n_removed > 0").select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("kept").alias("_kept"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", _t1 long, _t2 long"
    joined = own.mapInArrow(_keyed, schema).join(gone, ["_t1", "_t2"], "left")
    text = F.coalesce("_kept", "text")
    new = {"text": text} | ({"n_chars": F.when(F.col("_kept").isNotNull(), F.length("_kept")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    return restored(joined.withColumns(new))
