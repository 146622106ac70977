import pytest

from rasterflow.queries import ORACLE_SQL, QUERIES
from tests.helpers import duckdb_rows, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = spark_rows(QUERIES[name](spark, sf))
    assert got[1]
    if name in ORACLE_SQL:
        assert got == duckdb_rows(ORACLE_SQL[name], sf)
