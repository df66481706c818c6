"""Every query of the core beside its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests import differential

SF = "/root/testdata/sf0.001"
CORE = {k: v for m in entry._core() for k, v in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return differential.connection(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    said = differential.compare(spark, con, SF, CORE[name], entry.oracle_sql().get(name))
    assert not said.startswith("DIFFERS"), said


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
