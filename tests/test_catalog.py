"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import check
import pytest

import __spark_entry__ as spark_entry
from gleaner import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.oracle(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    problem = check.compare(name, spark, con, SF_DIR)
    assert problem in ("", "both empty"), problem


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(spark_entry.queries())


def test_the_library_does_not_import_the_training_data_part():
    code = "import sys, gleaner.catalog, gleaner.plans.loading; sys.exit(any(m.startswith('gleaner.llm') for m in sys.modules))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
