"""Queries of this subpackage against their DuckDB SQL."""

import duckdb
import pytest

from tidemark.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expected = con.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, expected))
