"""Queries of the training-data operators against their oracles, on the smallest tables."""

import duckdb
import pytest

from ledgerloom.llm import queries

from ..test_oracles import SF, TABLES, rows

RUN = queries.queries() | queries.more_queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = RUN[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())
