"""Every registered prose query against its SQL; those without SQL run and give rows."""

import pytest

import __spark_entry__ as entry
from quillspark.plans.oracles import ORACLES
from quillspark.plans.queries import QUERIES
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        same_rows(rows, duck.sql(ORACLES[name]).df())
    assert len(rows)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
