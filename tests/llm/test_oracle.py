"""The queries that SQL expresses against their DuckDB twins at sf0.01."""

import pytest

from tools.oracle_check import compare, duck_connect
from vigie.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    r = compare(spark, duck_connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert r["status"] == "ok", r
