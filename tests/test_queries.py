"""Every query runs; every query with SQL gives what the SQL gives."""

import pytest

import __spark_entry__ as entry
from tests import oracle
from tidewheel.plans import builders, draws, modelling, preparation, profiles, relational

CORE = {**preparation.QUERIES, **relational.QUERIES, **modelling.QUERIES, **profiles.QUERIES, **draws.QUERIES, **builders.QUERIES}
CORE_SQL = {**preparation.SQL, **relational.SQL, **modelling.SQL, **profiles.SQL, **draws.SQL, **builders.SQL}


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_against_sql(spark, small, connection, name):
    oracle.compare(CORE[name](spark, small), connection, CORE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_runs(spark, small, name):
    df = CORE[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.count()


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
