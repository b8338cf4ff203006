"""Every core query against its SQL on the smallest tables; those without SQL must run and keep their schema."""

from __future__ import annotations

import pytest

from tests.compare import connection, differs
from tonearm.plans import core_registry

CORE = core_registry()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", list(CORE.sql))
def test_equals_sql(spark, sf, con, name):
    assert differs(CORE.queries[name](spark, sf), con, CORE.sql[name]) == ""


@pytest.mark.parametrize("name", [n for n in CORE.queries if n not in CORE.sql])
def test_runs(spark, sf, name):
    df = CORE.queries[name](spark, sf)
    assert df.schema == CORE.queries[name](spark, sf).schema
    assert len(df.collect()) > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_does_not_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "tonearm"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tonearm.llm" not in p.read_text(), p


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
