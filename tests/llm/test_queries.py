"""Each registered query against its SQL, where it has one, and the pipeline's guard."""

import pytest
from quillspark.llm.queries import ORACLES, QUERIES

from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
