from pyspark.sql import functions as F

from auditloom.functions.sql import register_functions
from auditloom.operators.effects import resolve_path
from auditloom.operators.merkle import root_of
from auditloom.testing import frame, skippable


def test_functions_in_sql(spark):
    register_functions(spark)
    raws = [" \"a/b\" ", "C:/x", "\\\\s\\t/u", "/r", "", "plain", "q\""]
    rows = [(r, c) for r in raws for c in ("C:\\p\\", "", None, "/w")]
    frame_ = spark.createDataFrame(rows, "raw string, cwd string")
    frame_.createOrReplaceTempView("paths")
    got = [r.p for r in spark.sql("select resolve_path(raw, cwd) as p from paths").collect()]
    assert got == [r.p for r in frame_.select(resolve_path(F.col("raw"), F.col("cwd")).alias("p")).collect()]
    one = spark.sql("""select sensitive_flag('a/.ENV') as s, sensitive_flag('x') as n, severity_rank('high') as h, severity_rank('?') as q,
        stable_json('{"b":1,"a":[2.0]}') as j, stable_json('{') as bad, classify_delete('rm -rf /etc/a', '/w', 0) as d""").first()
    assert (one.s, one.n, one.h, one.q, one.j, one.bad) == ("sensitive-path:dotenv", None, 3, -1, '{"a":[2],"b":1}', None)
    assert one.d.flag == "destructive:system-target"
    got = spark.sql("""select classify_delete("$t = 'C:\\\\proj\\\\t'; Remove-Item $t -Recurse -Force", 'C:\\\\proj', 20).flag as a, classify_delete('rm -rf x', '', 0).flag as b,
        assess_effect('shell', 'undecidable', null, 'rm -rf /w; git push --force', true, '/w') as s, assess_effect('edit', 'partial', '/z/.npmrc', null, false, '/w') as e""").first()
    assert (got.a, got.b, got.s.severity, got.e.severity) == ("destructive:in-workspace", "destructive:target-unresolved", "critical", "critical")
    assert got.s.flags == ["shell", "effects-undecidable", "destructive:workspace-root", "destructive:git-push-force"] and got.e.flags == ["sensitive-path:npmrc", "outside-workspace", "partial-fidelity"]


def test_merkle_aggregate_and_frame_walk(spark):
    register_functions(spark)
    hashes = [bytes([i]) * 32 for i in range(5)]
    spark.createDataFrame([(h.hex(),) for h in hashes], "h string").coalesce(1).createOrReplaceTempView("hashes")
    assert spark.sql("select merkle_root(h) as r from hashes").first().r == root_of(hashes).hex()
    data = frame({"a": 1}) + skippable(b"xy") + frame({"b": 2})[:-3]
    spark.createDataFrame([(bytearray(data),)], "d binary").createOrReplaceTempView("blobs")
    got = [tuple(r) for r in spark.sql("select f.kind, f.skippable from blobs, lateral walk_frames(d) f").collect()]
    assert got == [("frame", False), ("frame", True), ("incomplete", None)]
