"""The training-data queries against their SQL on the smallest tables, and independence of the rest."""

import os
import subprocess
import sys

import pytest

from tellgrid.llm import queries, sql
from tests.test_registry import FOLDER, duck, rows_of  # noqa: F401

QUERIES, SQL = queries.queries(), sql.sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()


def test_nothing_else_needs_this_package():
    code = "import sys; sys.modules['tellgrid.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), 'p1_found' in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-1] == "False"
