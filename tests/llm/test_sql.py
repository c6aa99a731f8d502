"""The operators' SQL against their queries on the smallest tables."""

import duckdb
import pytest

from scriptorium.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    mine = queries.QUERIES[name](spark, tiny)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(mine.columns)
    assert sorted(str([r[c] for c in names]) for r in mine.collect()) == sorted(str(list(row)) for row in cursor.fetchall())
