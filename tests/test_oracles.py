"""Every registered query of the engine against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from quillstone.oracles import oracle_sql
from quillstone.queries import queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, same, sf, name):
    got = queries()[name](spark, sf)
    if name in oracle_sql():
        same(got, duck.sql(oracle_sql()[name]))
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
