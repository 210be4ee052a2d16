"""The training-data queries against their SQL."""

import duckdb
import pytest

from verdictmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, small):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{small}/{name_}.parquet')")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, small).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert text(got) == text(want)
