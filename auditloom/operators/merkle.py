"""Merkle trees (RFC 6962): roots, inclusion proofs and their verification.

Leaves are folded in aligned blocks of 2**16: every block but the last is a full subtree, so a tree's root
is the root over its blocks' roots. A round reads bounded groups and leaves one row for each block; two
rounds are enough for four thousand million leaves. A proof needs one block of leaves and the roots above.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BITS = 16
EMPTY_ROOT = hashlib.sha256(b"").digest()


def leaf_hash(data: Column) -> Column:
    """The hash of a leaf's bytes, as hex."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), data), 256)


def node_hash(left: Column, right: Column) -> Column:
    """The hash of two hex digests' node, as hex."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def _pair(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def levels(hashes: list[bytes]) -> list[list[bytes]]:
    """All levels of a tree, leaves first; a node without a sibling moves up as it is."""
    out = [hashes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([_pair(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return out


def root_of(hashes: list[bytes]) -> bytes:
    return levels(hashes)[-1][0] if hashes else EMPTY_ROOT


def _fold(key: tuple, table: pa.Table) -> pa.Table:
    rows = table.sort_by("pos")
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "hash": [root_of(rows.column("hash").to_pylist()).hex()], "n": pa.array([rows.num_rows], pa.int64())})


def _blocks(leaves: DataFrame, bits: int) -> DataFrame:
    """One row for each block: tree, pos, hash, n."""
    keyed = leaves.select("tree", F.shiftright("pos", bits).alias("block"), "pos", F.unhex("hash").alias("hash"))
    return keyed.groupBy("tree", "block").applyInArrow(_fold, "tree string, pos long, hash string, n long")


def merkle_roots(leaves: DataFrame, largest: int | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """tree, root, size of each tree of ``leaves`` (tree, pos from 0 without gaps, hash as hex).

    ``largest`` is a tree's greatest number of leaves where it is known; else it is counted. A tree
    without leaves has no row: its root is EMPTY_ROOT.
    """
    if largest is None:
        largest = leaves.agg(F.max("pos")).first()[0]
        largest = 0 if largest is None else largest + 1
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    rows = _blocks(leaves, bits)
    while largest > 1 << bits:
        largest = -(-largest >> bits)
        rows = _blocks(rows, bits)
    return rows.select("tree", F.col("hash").alias("root")).join(sizes, "tree")


def prove(leaves: DataFrame, tree: str, index: int, bits: int = BLOCK_BITS) -> dict:
    """The proof that a leaf is in its tree: its place, the tree's size and the sibling hashes upwards.

    The driver gets one block of leaves, then one block of the roots above it, and so on.
    """
    rows = leaves.filter(F.col("tree") == tree).select("tree", "pos", "hash")
    size = rows.count()
    if not 0 <= index < size:
        raise IndexError(f"leaf {index} of {size}")
    path, at, n = [], index, size
    while True:
        block = at >> bits
        own = [bytes.fromhex(r.hash) for r in rows.filter(F.shiftright("pos", bits) == block).orderBy("pos").collect()]
        # In the last block a node may be without a sibling; in the tree it then moves up too.
        place = at & ((1 << bits) - 1)
        for row in levels(own)[:-1]:
            other = place ^ 1
            if other < len(row):
                path.append({"hash": row[other].hex(), "side": "left" if place & 1 else "right"})
            place >>= 1
        n = -(-n >> bits)
        if n <= 1:
            return {"leaf": index, "size": size, "path": path}
        at, rows = block, _blocks(rows, bits).select("tree", "pos", "hash")


def verify(proof: dict, leaf: str, root: str) -> bool:
    """Whether a proof leads from a leaf's hash (hex) to a root. Its place and size don't count."""
    now = bytes.fromhex(leaf)
    for step in proof["path"]:
        other = bytes.fromhex(step["hash"])
        now = _pair(other, now) if step["side"] == "left" else _pair(now, other)
    return now.hex() == root


def verify_leaf(proof: dict, data: bytes, root: str) -> bool:
    return verify(proof, hashlib.sha256(b"\x00" + data).hexdigest(), root)


def verify_strictly(proof: dict, leaf: str, root: str) -> bool:
    """As verify, and the path must have the sides that the leaf's place in a tree of this size gives."""
    sides, place, n = [], proof["leaf"], proof["size"]
    if not 0 <= place < n:
        return False
    while n > 1:
        if place ^ 1 < n:
            sides.append("left" if place & 1 else "right")
        place, n = place >> 1, (n + 1) >> 1
    return sides == [s["side"] for s in proof["path"]] and verify(proof, leaf, root)


def verified(path: Column, leaf: Column) -> Column:
    """SQL: the root that a path (array of hash, side) leads to from a leaf's hash."""
    return F.aggregate(path, leaf, lambda now, s: F.when(s.side == "left", node_hash(s.hash, now)).otherwise(node_hash(now, s.hash)))


@F.pandas_udf(T.StringType())
def merkle_root(hashes: pd.Series) -> str:
    """Aggregate: the root over hex digests in the order they come; for groups that fit a task."""
    return root_of([bytes.fromhex(h) for h in hashes]).hex()


