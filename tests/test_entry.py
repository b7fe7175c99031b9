import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables aren't here")


@needs_data
def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert {r["name"] for r in rows} == {"read", "edit", "write", "bash", "web_fetch"} and sum(r.calls for r in rows) == 1000


@needs_data
@pytest.mark.parametrize("name", ["tool_call_stats", "turn_nodes", "version_chains", "risk_by_effect", "merkle_root", "merkle_proof", "log_round_trip"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    frame = __spark_entry__.queries()[name](spark, SMALL)
    cols = sorted(frame.columns)
    got = sorted([tuple(r[c] for c in cols) for r in frame.collect()], key=str)
    result = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted([tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in result.fetchall()], key=str)
    assert sorted(names) == cols and got == want


@needs_data
def test_a_round_trip_reads_its_logs_once(spark):
    """What counts the calls looks at their records twice; it reads a table, not the logs."""
    import __spark_entry__

    plan = __spark_entry__.queries()["log_round_trip"](spark, SMALL)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "parquet" in plan


def test_every_query_with_sql_is_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_package(tmp_path):
    """The entry module imports, and has the engine's queries, when the subpackage is gone."""
    for name in ("auditloom", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "auditloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tool_call_stats' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=60)


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "auditloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "auditloom").parts:
            assert "auditloom.llm" not in path.read_text(), path
