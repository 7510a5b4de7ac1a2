"""Every registered query against its SQL, on the small tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, database, differences

SMALL = f"{DATA}/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert differences(spark, con, QUERIES[name], SQL[name], SMALL) == []
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["subject_id", "specimen_type", "D1_start"]
