"""Every registered query against its SQL text on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from runledger.plans import contract, oracles

SF = Path("/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def _rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    assert got == _rows([c[0] for c in cursor.description], cursor.fetchall())
