import hashlib
import json

import pytest
from pyspark.sql import functions as F

from auditloom import attest
from auditloom.operators import merkle
from auditloom.operators.manifest import build_manifest, generate_key, public_key, record_leaves, sign_manifest, strict_lines, verify_manifest, verify_signature
from auditloom.testing import frame, log, session_records


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def by_split(leaves):
    """The root by the definition: split at the largest power of two below the size."""
    if not leaves:
        return sha(b"")
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return sha(b"\x01", by_split(leaves[:k]), by_split(leaves[k:]))


def leaves(n, tree=""):
    return [sha(b"\x00", f"{tree}leaf-{i}".encode()) for i in range(n)]


def frame_of(spark, trees):
    rows = [(t, i, h.hex()) for t, hs in trees.items() for i, h in enumerate(hs)]
    return spark.createDataFrame(rows, "tree string, pos long, hash string").repartition(5)


def test_roots_by_hand_and_of_all_sizes():
    a, b, c, d, e = leaves(5)
    n = lambda x, y: sha(b"\x01", x, y)
    assert merkle.root_of([]) == sha(b"") and merkle.root_of([a]) == a and merkle.root_of([a, b]) == n(a, b)
    assert merkle.root_of([a, b, c]) == n(n(a, b), c) and merkle.root_of([a, b, c, d, e]) == n(n(n(a, b), n(c, d)), e)
    assert all(merkle.root_of(leaves(k)) == by_split(leaves(k)) for k in range(70))


@pytest.mark.parametrize("bits", [2, 3, 16])
def test_folding_by_blocks(spark, bits):
    sizes = [1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 64, 65, 99]
    got = {r.tree: (r.root, r.size) for r in merkle.merkle_roots(frame_of(spark, {str(k): leaves(k) for k in sizes}), bits=bits).collect()}
    assert got == {str(k): (by_split(leaves(k)).hex(), k) for k in sizes}


def test_proofs(spark):
    for n in (1, 2, 7, 21):
        hs, frame_ = leaves(n), frame_of(spark, {"t": leaves(n), "u": leaves(3)}).persist()
        root = by_split(hs).hex()
        for i in {0, n // 2, n - 1}:
            proof = merkle.prove(frame_, "t", i, bits=2)
            assert merkle.verify(proof, hs[i].hex(), root) and merkle.verify_strictly(proof, hs[i].hex(), root) and merkle.verify_leaf(proof, f"leaf-{i}".encode(), root)
            assert not merkle.verify(proof, sha(b"\x00", b"other").hex(), root)
            if proof["path"]:
                assert not merkle.verify_strictly(proof | {"leaf": i ^ 1}, hs[i].hex(), root)
                assert not merkle.verify(proof | {"path": proof["path"][:-1]}, hs[i].hex(), root)
                path = spark.createDataFrame([([tuple(s[k] for k in ("hash", "side")) for s in proof["path"]], hs[i].hex())], "path array<struct<hash:string,side:string>>, leaf string")
                assert path.select(merkle.verified(F.col("path"), F.col("leaf")).alias("r")).first().r == root
    with pytest.raises(IndexError):
        merkle.prove(frame_, "t", 21)


def test_all_proofs_of_all_sizes():
    for n in range(1, 34):
        hs = leaves(n)
        tree = merkle.levels(hs)
        for i in range(n):
            place, path = i, []
            for row in tree[:-1]:
                if place ^ 1 < len(row):
                    path.append({"hash": row[place ^ 1].hex(), "side": "left" if place & 1 else "right"})
                place >>= 1
            proof = {"leaf": i, "size": n, "path": path}
            assert merkle.verify_strictly(proof, hs[i].hex(), by_split(hs).hex())
            assert not path or not merkle.verify(proof, hs[(i + 1) % n].hex(), by_split(hs).hex())


def test_a_node_is_no_leaf():
    a, b = leaves(2)
    assert merkle.root_of([a, b]) != sha(b"\x00", a, b)


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("m") / "session.jsonl.zstd"
    p.write_bytes(log(session_records(3, 2)))
    return str(p)


def test_manifest_and_tampering(spark, path, tmp_path):
    records = session_records(3, 2)
    manifest = attest(spark, path)
    data = open(path, "rb").read()
    lines = [json.dumps(r, ensure_ascii=False, separators=(",", ":")).encode() for r in records]
    assert manifest["recordRoot"] == by_split([sha(b"\x00", x) for x in lines]).hex() and manifest["sessionId"] == "synthetic-session"
    assert (manifest["bytes"], manifest["frames"], manifest["records"], manifest["file"]) == (len(data), len(records), len(records), "session.jsonl.zstd")
    assert verify_manifest(spark, path, manifest)["ok"]
    first, second = len(frame(records[0])), len(frame(records[1]))
    swapped = data[first : first + second] + data[:first] + data[first + second :]
    flipped = bytearray(data)
    flipped[first + 12] ^= 1
    other = tmp_path / "session.jsonl.zstd"
    for changed, fields in ((bytes(flipped), ("frames", "records", "frameRoot")), (data[:-3], ("bytes",)), (data + frame({"type": "z"}), ("bytes",)), (swapped, ("frameRoot",))):
        other.write_bytes(changed)
        assert verify_manifest(spark, str(other), manifest)["mismatch"] in fields
    assert build_manifest(spark, path, max_bytes=first + 5)["frames"] == 1


def test_signatures(spark, path):
    manifest, key = attest(spark, path), generate_key()
    signed = sign_manifest(spark, manifest, key)
    assert verify_signature(spark, signed) and signed["signerPublicKey"] == public_key(key)
    for field in ("frameRoot", "bytes", "file", "generatedAt"):
        assert not verify_signature(spark, signed | {field: "x"})
    assert not verify_signature(spark, manifest) and not verify_signature(spark, signed | {"signerPublicKey": None}) and not verify_signature(spark, signed | {"signerPublicKey": "nonsense"})
    assert not verify_signature(spark, signed | {"signerPublicKey": public_key(generate_key())})


def test_public_key_of_the_standard():
    from auditloom.operators.manifest import _public_bytes

    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert _public_bytes(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"


def test_disclosing_one_record(spark, path):
    rows = strict_lines(spark, path)
    leaves_ = record_leaves(rows).persist()
    one = leaves_.filter("record_type = 'tool/call'").orderBy("pos").limit(1).first()
    line = rows.filter(f"row_kind = 'line' and frame_index = {one.frame_index}").first().line
    proof, root = merkle.prove(leaves_, path, one.pos), attest(spark, path)["recordRoot"]
    assert merkle.verify_leaf(proof, line.encode(), root) and not merkle.verify_leaf(proof, line.replace("call", "ball").encode(), root)
