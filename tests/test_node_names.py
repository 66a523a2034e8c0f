"""Hosts whose names have four digits, against SQL."""

from pathlib import Path

import duckdb
import pytest
from runledger.plans import contract, oracles

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def many_nodes(tmp_path_factory):
    """The smallest tables with node numbers around 10 000, where names of four digits no longer run on."""
    folder = tmp_path_factory.mktemp("nodes")
    for f in SF.glob("*.parquet"):
        numbers = "* replace (l_suppkey + 9995 as l_suppkey)" if f.stem == "lineitem" else "*"
        duckdb.sql(f"copy (select {numbers} from '{f}') to '{folder / f.name}' (format parquet)")
    return folder


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
@pytest.mark.parametrize("name", ["hostlist_expand_count", "entity_rates_biased", "entity_rates_biased_summary", "exclude_top8", "node_notes"])
def test_hosts_of_many_nodes(spark, many_nodes, name):
    con = duckdb.connect()
    for f in many_nodes.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = contract.queries()[name](spark, str(many_nodes))
    want = con.execute(oracles.oracle_sql()[name])
    places = [df.columns.index(c[0]) for c in want.description]

    def rows(data):
        return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in data), key=repr)

    assert rows([tuple(r[i] for i in places) for r in df.collect()]) == rows(want.fetchall())
