"""Registered queries against their SQL, and that each runs."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from seriesloom.llm.queries import QUERIES, SQL
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    ok, note = compare(spark, connection(SF), QUERIES[name], SQL[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_a_row_per_document(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_are_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries()


def test_tasks_bring_their_code_along(tmp_path):
    """Executors find no copy of the package: neither in the working folder nor on their path."""
    root = str(Path(__file__).parents[2])
    text = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from seriesloom.session import local_session\nimport __spark_entry__ as e\n"
        "spark = local_session(2, 2, '2g')\n"
        f"for name in ('op3_block_anchors', 'op4_token_counts'): print('rows', e.queries()[name](spark, {SF!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.count("rows 200") == 2, out.stderr[-2000:]
