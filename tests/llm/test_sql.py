"""The operators that SQL can say, against it."""

import os

import duckdb
import pandas as pd
import pytest

from matchloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df().astype("object")
    got = QUERIES[name](spark, sf).toPandas().astype("object")[list(want.columns)]
    told = lambda df: sorted(tuple("-" if pd.isna(x) else str(int(x) if isinstance(x, float) else x) for x in r) for r in df.itertuples(index=False))
    assert told(got) == told(want)
