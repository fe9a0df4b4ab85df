"""Every registered query of the linkage engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from matchloom.oracle import ORACLE_SQL
from matchloom.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    told = lambda x: None if pd.isna(x) else float(x) if isinstance(x, float) else x
    return sorted((tuple(map(told, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if not os.path.isdir(sf):
        pytest.skip("no driver tables here")
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        # edit-based measures and models: test_linkage.py holds them against definitions; here their rows are those of the pairs
        assert len(got) and not got.isna().any().any()
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


def test_sql_only_for_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
