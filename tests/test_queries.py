"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from rillmark import plans

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list:
    def plain(value):
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return None
        return value if isinstance(value, str) else str(value) if isinstance(value, bool) else float(value) if hasattr(value, "__float__") else str(value)

    return sorted((tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = plans.queries()[name](spark, SF_DIR).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
