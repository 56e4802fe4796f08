"""Every query of the catalogue against its SQL, at the smallest size."""

import pytest
from conftest import SMALL, rows_of

from larkspur.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        assert rows_of(got) == rows_of(oracle.execute(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
