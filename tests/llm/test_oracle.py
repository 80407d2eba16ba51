"""The training-data queries that have SQL, against it."""

import pytest

from folio.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, difference


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name, folder):
    assert difference(spark, connect(folder), QUERIES[name], ORACLE_SQL[name], folder) is None
