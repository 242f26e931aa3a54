"""Registered queries of the engine against their DuckDB SQL."""

import duckdb
import pytest

from tidemark.queries import KEYS, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in KEYS:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = con.execute(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
