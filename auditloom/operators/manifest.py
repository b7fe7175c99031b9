"""Manifests: what a log is, so that any change to it shows."""

from __future__ import annotations

import base64
import os
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.jsonish import dump
from auditloom.operators.merkle import EMPTY_ROOT, merkle_roots
from auditloom.operators.records import prefix_metadata
from auditloom.schemas import MISMATCHES
from auditloom.sources.sessionlog import register
from auditloom.sources.store import size_of

ALGORITHM = "sha256/rfc6962"


def strict_lines(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Frames and lines of logs for proofs."""
    register(spark)
    reader = spark.read.format("sessionlog").option("path", path).option("mode", "strict")
    return (reader.option("maxBytes", max_bytes) if max_bytes else reader).load()


def frame_leaves(rows: DataFrame) -> DataFrame:
    """tree, pos, hash of the frames; a frame's place is its number."""
    return rows.filter("row_kind = 'frame'").select(F.col("path").alias("tree"), F.col("frame_index").alias("pos"), F.lower(F.hex("leaf")).alias("hash"))


def record_leaves(rows: DataFrame) -> DataFrame:
    """tree, pos, hash of the lines with their metadata; a log's lines are one partition in order."""
    lines = prefix_metadata(rows.filter("row_kind = 'line'"))
    pos = F.row_number().over(Window.partitionBy("path").orderBy("frame_index", "line_no")) - 1
    return lines.select(
        F.col("path").alias("tree"), pos.cast("long").alias("pos"), F.lower(F.hex("leaf")).alias("hash"), F.col("meta_seq").alias("seq"), F.col("meta_type").alias("record_type"),
        "frame_index", "frame_start", F.col("bytes").alias("byte_length"), F.col("meta_session_id").alias("session_id"),
    )


def build_manifest(spark: SparkSession, path: str, max_bytes: int | None = None, at: int | None = None) -> dict[str, Any]:
    """The manifest of one log (of its first ``max_bytes``)."""
    rows = strict_lines(spark, path, max_bytes).persist()
    try:
        trees = {}
        for name, leaves in (("frame", frame_leaves(rows)), ("record", record_leaves(rows).select("tree", "pos", "hash"))):
            found = merkle_roots(leaves).first()
            trees[name] = (found.root, found.size) if found else (EMPTY_ROOT.hex(), 0)
        session = record_leaves(rows).filter("record_type = 'session' and session_id is not null").orderBy(F.desc("pos")).limit(1).first()
    finally:
        rows.unpersist()
    size = size_of(path)
    manifest = {"version": 1, "algorithm": ALGORITHM} | ({"sessionId": session.session_id} if session else {})
    return manifest | {
        "file": path.replace("\\", "/").rpartition("/")[2], "bytes": min(size, max_bytes) if max_bytes else size, "frames": trees["frame"][1], "records": trees["record"][1],
        "frameRoot": trees["frame"][0], "recordRoot": trees["record"][0], "generatedAt": int(time.time() * 1000) if at is None else at,
    }


def verify_manifest(spark: SparkSession, path: str, expected: dict[str, Any]) -> dict[str, Any]:
    """Whether a log still is what its manifest says; else the first field that differs."""
    now = build_manifest(spark, path)
    actual = {f: now[f] for f in MISMATCHES}
    wrong = next((f for f in MISMATCHES if actual[f] != expected.get(f)), None)
    return {"ok": wrong is None, "mismatch": wrong, "actual": actual}


def _signable(manifest: dict[str, Any]) -> bytes:
    return dump({k: v for k, v in manifest.items() if k not in ("signature", "signerPublicKey")}, ordered=True).encode()


def _der(pem: str) -> bytes:
    return base64.b64decode("".join(x for x in pem.splitlines() if x and not x.startswith("-----")))


def _pem(der: bytes, label: str) -> str:
    text = base64.b64encode(der).decode()
    return f"-----BEGIN {label}-----\n" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + f"\n-----END {label}-----\n"


#: What stands before the 32 bytes of an Ed25519 key in PKCS 8 and in a public key's encoding.
_PRIVATE, _PUBLIC = bytes.fromhex("302e020100300506032b657004220420"), bytes.fromhex("302a300506032b6570032100")


def generate_key() -> str:
    """A new Ed25519 private key as PEM; any 32 random bytes are one."""
    return _pem(_PRIVATE + os.urandom(32), "PRIVATE KEY")


def public_key(private_pem: str) -> str:
    """The public key of a private one."""
    return _pem(_PUBLIC + _public_bytes(_der(private_pem)[len(_PRIVATE) :]), "PUBLIC KEY")


def _public_bytes(seed: bytes) -> bytes:
    """An Ed25519 public key (RFC 8032, section 5.1.5) by the curve's own arithmetic."""
    import hashlib

    p = 2**255 - 19
    d = -121665 * pow(121666, -1, p) % p
    y = 4 * pow(5, -1, p) % p
    x2 = (y * y - 1) * pow(d * y * y + 1, -1, p) % p
    x = pow(x2, (p + 3) // 8, p)
    if (x * x - x2) % p:
        x = x * pow(2, (p - 1) // 4, p) % p
    if x & 1:
        x = p - x

    def add(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
        e, f = (a[1] - a[0]) * (b[1] - b[0]) % p, (a[1] + a[0]) * (b[1] + b[0]) % p
        g, h = 2 * a[3] * b[3] * d % p, 2 * a[2] * b[2] % p
        u, v, w, t = f - e, h - g, h + g, f + e
        return u * v % p, w * t % p, v * w % p, u * t % p

    scalar = int.from_bytes(hashlib.sha512(seed).digest()[:32], "little") & ~7 & ~(1 << 255) | 1 << 254
    total, point = (0, 1, 1, 0), (x, y, 1, x * y % p)
    while scalar:
        if scalar & 1:
            total = add(total, point)
        point, scalar = add(point, point), scalar >> 1
    inverse = pow(total[2], -1, p)
    return ((total[1] * inverse % p) | ((total[0] * inverse % p & 1) << 255)).to_bytes(32, "little")


def sign_manifest(spark: SparkSession, manifest: dict[str, Any], private_pem: str) -> dict[str, Any]:
    """The manifest with an Ed25519 signature over all its other fields, and the signer's public key."""
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(_der(private_pem)))
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(key)
    signer.update(_signable(manifest))
    return manifest | {"signature": base64.b64encode(bytes(signer.sign())).decode(), "signerPublicKey": public_key(private_pem)}


def verify_signature(spark: SparkSession, manifest: dict[str, Any]) -> bool:
    """False for an unsigned manifest, a missing or malformed key, or any change to what was signed."""
    if not manifest.get("signature") or not manifest.get("signerPublicKey"):
        return False
    from py4j.protocol import Py4JError

    jvm = spark._jvm
    try:
        key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(_der(manifest["signerPublicKey"])))
        check = jvm.java.security.Signature.getInstance("Ed25519")
        check.initVerify(key)
        check.update(_signable(manifest))
        return bool(check.verify(base64.b64decode(manifest["signature"])))
    except (Py4JError, ValueError):
        return False
