"""Every timeline query against its SQL on the smallest tables; the others must run."""

import pytest

from chronoloom.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, FOLDER))
    if name in ORACLE_SQL:
        assert got == duck(ORACLE_SQL[name], FOLDER)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
