"""Every registered query runs; those with SQL give the same rows."""

import pytest
from oracle import compare, connect

from chronotext.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE_SQL:
        assert compare(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
