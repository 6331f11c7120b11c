import pytest

from fleetgauge import catalogue, oracle
from tests.compare import connect, duckdb_rows, spark_rows

SF = "/root/testdata/sf0.01"
QUERIES = catalogue.queries()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    expected_columns, expected = duckdb_rows(con, ORACLE[name])
    assert columns == expected_columns
    assert len(expected) > 0
    assert rows == expected
