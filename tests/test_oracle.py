"""Every registered query against its DuckDB SQL twin at sf0.01."""

import os

import pytest

import __spark_entry__ as E
from vigie.plans.oracle import ORACLE_SQL
from tools.oracle_check import compare, duck_connect

from .conftest import SF_ORACLE

pytestmark = pytest.mark.skipif(not os.path.exists(SF_ORACLE), reason="driver tables missing")


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(E.QUERIES))
def test_query_matches_oracle(spark, con, name):
    sql = ORACLE_SQL.get(name)
    r = compare(spark, con, name, E.QUERIES[name], sql, SF_ORACLE)
    assert r["status"] in ("ok", "rows-only"), r
    if sql is None:
        assert r["spark_rows"] > 0


def test_every_query_has_sql():
    assert set(E.QUERIES) == set(ORACLE_SQL) and set(ORACLE_SQL) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["extract_date", "code_dep", "Departement", "tx_pos", "couleur", "geometry",
                          "nom_minuscules"]
    assert df.count() == 26
