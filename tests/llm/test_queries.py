"""Every query of the subpackage on the smallest tables, beside its SQL where there is one."""

from pathlib import Path

import pytest

from folioscope.llm import queries, sql
from tests import differential

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return differential.connection(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, con, name):
    said = differential.compare(spark, con, SF, queries.queries()[name], sql.oracle_sql().get(name))
    assert not said.startswith("DIFFERS"), said
