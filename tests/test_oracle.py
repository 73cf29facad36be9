"""Every registered query against its DuckDB oracle on the supplied tables."""

import pytest

from data_paths import SMALL
from oracle_compare import compare, duck
from stockroom.plans import REGISTRY

WITH_ORACLE = sorted(n for n, q in REGISTRY.items() if q.oracle)
WITHOUT_ORACLE = sorted(n for n, q in REGISTRY.items() if not q.oracle)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_matches_oracle(spark, con, name):
    res = compare(spark, SMALL, name, con)
    assert res["status"] == "ok", res


def test_every_query_has_an_oracle():
    assert WITHOUT_ORACLE == []


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(REGISTRY) <= set(qs)
