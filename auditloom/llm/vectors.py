"""Near-duplicate vectors by tiled comparison in PCA order (operator 6).

Vectors are scaled to unit length and rotated so that the leading dimensions hold most of the variance.
They are dealt into tiles of bounded size, neighbours together: by range of the first dimension over the
cluster, by medians inside a partition. A tile is a file in the shared folder; what is joined and shuffled
are tiles' outlines. Two tiles are compared only if their ranges in the two leading dimensions and
their centres and radii leave room for a pair at the threshold; the task that compares them reads their files.
In a pair of tiles products are accumulated from the leading dimensions on; what the rest can add is bounded by the product of the
suffix norms, and a pair is given up as soon as its cosine cannot reach the threshold any more.

Equal vectors are one vector with a count. A pair of tiles returns for each vector the number of its
links and one link to its local component, however many links there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import mapped, writing
from .scratch import Scratch

THRESHOLD = 0.95
#: Vectors of a tile at most; vectors that the rotation is fitted on at most (it decides speed, not results).
TILE, SAMPLE = 2048, 4096
#: Dimensions after which products are bounded; rounding errors that a bound allows for.
STAGES, SLACK = (8, 16, 32, 64, 128, 256, 512), 1e-9


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Principal directions of unit vectors about the origin, the one with most of their squares first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, directions = np.linalg.eigh(unit.T @ unit)
    return directions[:, ::-1]


def _rotated(x: np.ndarray, rotations: dict[int, np.ndarray]) -> np.ndarray:
    # Scaled twice: squares of very large or very small components would overflow.
    x = x / np.abs(x).max(1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    r = rotations.get(x.shape[1])
    return unit if r is None else unit @ r


def _by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        yield d, np.flatnonzero(sizes == d)


def _leading(batches: Iterator[pa.RecordBatch], rotations: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, rows in _by_size(batch, 1):
            some = batch.take(pa.array(rows))
            y = _rotated(_matrix(some.column(1), d), rotations)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), d, np.int32)), pa.array(y[:, 0])], names=["node", "v", "copies", "d", "lead"])


def _halves(y: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Cut at the median of the dimension with the widest spread until each part is small enough."""
    if len(rows) <= size:
        yield rows
        return
    widest = int(np.ptp(y[rows], axis=0).argmax())
    order = rows[np.argsort(y[rows, widest], kind="stable")]
    yield from _halves(y, order[: len(order) // 2], size)
    yield from _halves(y, order[len(order) // 2 :], size)


def _tiles(batches: Iterator[pa.RecordBatch], rotations: dict[int, np.ndarray], size: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition, each in a file; a partition is read in pieces of some tiles, so none is held whole.

    Files have names of their own in every attempt, and only those of an attempt that ends are listed.
    """
    from pyspark import TaskContext

    part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal number
        table = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in table:
            for d, rows in _by_size(batch, 1):
                x = _matrix(batch.column(1).take(pa.array(rows)), d)
                y = _rotated(x, rotations)
                nodes, copies = (batch.column(i).to_numpy()[rows] for i in (0, 2))
                for own in _halves(y, np.arange(len(rows)), size):
                    centre, name = y[own].mean(0), f"{attempt}-{number}"
                    with writing(f"{folder}/{name}") as out:
                        for column in (np.array([len(own)], "<i8"), nodes[own].astype("<i8"), copies[own].astype("<i8"), x[own].astype("<f8")):
                            out.write(column.tobytes())
                    low, high = (f(y[own, :2], 0).tolist() for f in (np.min, np.max))
                    yield pa.RecordBatch.from_pydict({
                        "tile": [(part << 32) + number], "name": [name], "d": pa.array([d], pa.int32()), "low": pa.array([low], pa.list_(pa.float64())), "high": pa.array([high], pa.list_(pa.float64())),
                        "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [float(np.sqrt(((y[own] - centre) ** 2).sum(1).max()))],
                    })
                    number += 1

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 8 * size:
            yield from cut(held)
            held, n = [], 0
    if held:
        yield from cut(held)


def close_pairs(y: np.ndarray, z: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors with a product of at least ``threshold`` - SLACK, and the products."""
    d = y.shape[1]
    stops = [s for s in STAGES if s < d] + [d]
    rest_y, rest_z = ([np.sqrt((m[:, s:] ** 2).sum(1)) for s in stops] for m in (y, z))
    found = []
    for at in range(0, len(y), 256):
        some, begin = y[at : at + 256], 0
        product, pairs = np.zeros((len(some), len(z))), None
        for k, stop in enumerate(stops):
            if pairs is None:
                product += some[:, begin:stop] @ z[:, begin:stop].T
                alive = product + rest_y[k][at : at + 256, None] * rest_z[k] >= threshold - SLACK
                if stop == d or np.count_nonzero(alive) < 0.05 * alive.size:
                    i, j = np.nonzero(alive)
                    pairs = i, j, product[i, j]
            else:
                i, j, p = pairs
                p = p + np.einsum("ij,ij->i", some[i, begin:stop], z[j, begin:stop])
                alive = p + rest_y[k][at + i] * rest_z[k][j] >= threshold - SLACK
                pairs = i[alive], j[alive], p[alive]
            begin = stop
        found.append((pairs[0] + at, pairs[1], pairs[2]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least_of_components(n: int, u: np.ndarray, v: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each of n places the least name that its links reach."""
    least = names.copy()
    while True:
        before = least.copy()
        m = np.minimum(least[u], least[v])
        np.minimum.at(least, u, m)
        np.minimum.at(least, v, m)
        if np.array_equal(before, least):
            return least


def _tile(folder: str, name: str, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tile's nodes, copies and vectors."""
    raw = mapped(f"{folder}/{name}")
    n = int(raw[:8].view("<i8")[0])
    return raw[8 : 8 + 8 * n].view("<i8"), raw[8 + 8 * n : 8 + 16 * n].view("<i8"), raw[8 + 16 * n :].view("<f8").reshape(n, d)


def _compare(batches: Iterator[pa.RecordBatch], rotations: dict[int, np.ndarray], threshold: float, folder: str) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple] = {}
    for batch in batches:
        for a_name, b_name, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            a, b = 0, int(a_name != b_name)  # a tile with itself comes alone
            for name in (a_name, b_name):
                if name not in held:
                    if len(held) >= 4:
                        held = {a_name: held[a_name]} if a_name in held else {}
                    own = _tile(folder, name, d)
                    held[name] = (*own, _rotated(own[2], rotations))
            ids, copies, x, y = zip(*[held[name] for name in ([a_name] if a == b else [a_name, b_name])], strict=True)
            i, j, p = close_pairs(y[a], y[b], threshold)
            if a == b:
                i, j, p = (w[i < j] for w in (i, j, p))
            # At the threshold the cosine of the vectors as they came decides.
            edge = np.flatnonzero(np.abs(p - threshold) <= 1e-6)
            if len(edge):
                s, t = x[a][i[edge]], x[b][j[edge]]
                s, t = (m / np.abs(m).max(1, keepdims=True) for m in (s, t))
                p[edge] = np.einsum("ij,ij->i", s, t) / (np.sqrt(np.einsum("ij,ij->i", s, s)) * np.sqrt(np.einsum("ij,ij->i", t, t)))
            i, j = i[p >= threshold], j[p >= threshold]
            n = len(ids[a])
            names = ids[a] if a == b else np.concatenate([ids[a], ids[b]])
            j_all = j if a == b else j + n
            links = np.bincount(i, copies[b][j], len(names)) + np.bincount(j_all, copies[a][i], len(names))
            least = least_of_components(len(names), i, j_all, names)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({"u": names[some], "v": least[some], "links": links[some].astype(np.int64)})


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, size: int = TILE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero, or has a null or non-finite component is linked with nothing: its
    component is its own vec_id. Vectors of different lengths aren't linked. Equal vectors are linked
    whatever their labels or ids; component_id is the least vec_id of a component that isn't null.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = own.withColumn("v", F.when(fine, F.col("v")))
    classes = scratch.table(usable.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")).select(F.monotonically_increasing_id().alias("node"), "v", "copies", "first_id"), "classes")

    some = [np.array(r.v) for r in classes.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()]
    rotations = {}
    for d in {len(v) for v in some}:
        m = np.stack([v for v in some if len(v) == d])
        rotations[d] = rotation(m / np.abs(m).max(1, keepdims=True))
    parts = max(1, -(-classes.count() // (4 * size)))
    lead = classes.select("node", "v", "copies").mapInArrow(lambda it: _leading(it, rotations), "node long, v array<double>, copies long, d int, lead double")
    lead = scratch.table(lead, "lead")
    dealt = lead.repartitionByRange(parts, "d", "lead").sortWithinPartitions("d", "lead").select("node", "v", "copies")
    folder = f"{scratch.path}/tile-files"
    tiles = dealt.mapInArrow(lambda it: _tiles(it, rotations, size, folder), "tile long, name string, d int, low array<double>, high array<double>, centre array<double>, radius double")
    tiles = scratch.table(tiles, "tiles")
    scratch.drop("lead")

    # Unit vectors with that cosine are at most so far apart.
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9

    def cells(side: str, room: float) -> DataFrame:
        """Tiles with the cells of the two leading dimensions that they and ``room`` above them reach into."""
        out = tiles.select(*[F.col(c).alias(f"{c}_{side}") for c in tiles.columns if c != "d"], "d")
        for k in (0, 1):
            low, high = (F.coalesce(F.get(f"{c}_{side}", F.lit(k)), F.lit(0.0)) for c in ("low", "high"))
            out = out.withColumn(f"cell{k}", F.explode(F.sequence(F.floor((low - room) / reach), F.floor((high + room) / reach))))
        return out

    apart = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    meet = F.forall(F.zip_with("low_a", "high_b", lambda x, y: x <= y + reach), lambda t: t) & F.forall(F.zip_with("low_b", "high_a", lambda x, y: x <= y + reach), lambda t: t)
    near = (F.col("tile_a") <= F.col("tile_b")) & meet & (apart <= F.col("radius_a") + F.col("radius_b") + reach)
    pairs = cells("a", 0.0).join(cells("b", reach), ["d", "cell0", "cell1"]).filter(near).groupBy("tile_a", "tile_b").agg(F.first("name_a").alias("name_a"), F.first("name_b").alias("name_b"), F.first("d").alias("d"))
    # A task has pairs of one tile next to each other, and a tile's pairs are spread over some tasks.
    pairs = scratch.table(pairs, "pairs")
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // 32))
    dealt = pairs.repartition(tasks, "tile_a", F.pmod(F.col("tile_b"), F.lit(8))).sortWithinPartitions("tile_a", "tile_b").select("name_a", "name_b", "d")
    found = scratch.table(dealt.mapInArrow(lambda it: _compare(it, rotations, threshold, folder), "u long, v long, links long"), "found")
    scratch.drop("tile-files")
    scratch.drop("tiles", "pairs")

    links = found.groupBy("u").agg(F.sum("links").alias("others")).withColumnRenamed("u", "node")
    joined = components(found.select("u", "v"), scratch, "near")
    placed = classes.join(links, "node", "left").join(joined, "node", "left")
    placed = scratch.table(placed.select("v", "first_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "placed")
    # Written, so that the join with a component of very many vectors can be split.
    named = scratch.table(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "named")
    out = usable.filter("v is not null").join(placed.join(named, "component").select("v", "n_links", "component_id"), "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = out.unionByName(usable.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    out = scratch.table(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")
    scratch.drop("classes", "found", "placed", "named")
    return out
