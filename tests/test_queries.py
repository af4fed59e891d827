"""Every registered query against its SQL on DuckDB, and the others for rows and stable schemas."""

import oracle
import pytest

from tessera import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert oracle.differences(Q[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_has_rows(spark, sf, name):
    assert not Q[name](spark, sf).isEmpty()


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_imports_without_the_corpus_operators(tmp_path, pipeline):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if pipeline and os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) + %d" % len(set(Q) - set(SQL))
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.parametrize("name, deals", [("reconstruct_irls", 2), ("reconstruct_mean", 2), ("reconstruct_round_trip", 2), ("gaussian_blur", 1)])
def test_pixels_go_neither_through_the_driver_nor_into_joins(spark, sf, name, deals):
    plan = Q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and plan.count("Exchange") == deals
