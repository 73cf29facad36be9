import duckdb
import pytest

from stockroom.llm.queries import ORACLES, QUERIES
from texts import MEDIUM

TABLES = ("documents", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{MEDIUM}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, MEDIUM)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    have = sorted(tuple(r[c] for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    rows = sorted(tuple(r[i] for i in place) for r in want.fetchall())
    assert len(have) == len(rows)
    assert have == rows


def test_every_query_has_its_name():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
