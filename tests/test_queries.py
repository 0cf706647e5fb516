"""Every registered query of the library gives the rows of its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from locusflow.plans import alignment_queries, interval_queries, job_queries, metric_queries, score_queries, sequence_queries, source_queries, table_queries  # noqa: F401
from locusflow.plans.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, np.ma.MaskedArray):
        v = v.tolist()
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "null"
    return f"{v:.8g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df: pd.DataFrame):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, wanted = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


