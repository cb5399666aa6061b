"""The driver contract, and every query with SQL against that SQL."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
ROOT = str(Path(__file__).parents[1])

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, entry_module.queries()[name], entry_module.oracle_sql()[name], SF)
    assert ok, note


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_runs_from_another_folder(tmp_path):
    """Tasks must not depend on finding the package in their working folder."""
    text = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from seriesloom.session import local_session\nimport __spark_entry__ as e\n"
        "df = e.entry(local_session(2, 2, '2g')); n = df.count()\n"
        "assert n > 0 and df.columns == ['key', 'ds', 'yhat', 'yhat_lower', 'yhat_upper']\nprint('rows', n)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
