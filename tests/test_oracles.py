"""Every query of the library against its SQL, and those without SQL for a stable schema and reruns that agree."""

import pytest

from pitsight.plans import ORACLES, QUERIES

from oracle import DATA, connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    wanted_columns, wanted = sql_rows(con, ORACLES[name])
    assert columns == wanted_columns
    assert len(rows) == len(wanted)
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_repeats(spark, name):
    first, again = spark_rows(QUERIES[name](spark, DATA)), spark_rows(QUERIES[name](spark, DATA))
    assert first == again and first[1]
