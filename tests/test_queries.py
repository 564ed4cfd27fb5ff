"""Every query beside its SQL on the smallest tables; the optional subpackage can be missing."""

import subprocess
import sys
from pathlib import Path

import pytest

from tests.compare import compare

ROOT = str(Path(__file__).resolve().parent.parent)


def core():
    from tessaria import data_queries, kpi_queries, table_queries

    queries = {**data_queries.QUERIES, **kpi_queries.QUERIES, **table_queries.QUERIES}
    sql = {**data_queries.SQL, **kpi_queries.SQL, **table_queries.SQL}
    return queries, sql


QUERIES, SQL = core()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, small, name):
    assert compare(spark, small, QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["i", "week", "value", "z", "role"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['tessaria.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p3_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
