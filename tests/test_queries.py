"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
ALL = sorted(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", [n for n in ALL if n in SQL])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(SQL[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda rows: sorted(rows, key=repr)
    cell = lambda v: None if v is None or v is pd.NA or v != v else str(int(v) if isinstance(v, float) and v.is_integer() else v)
    text = lambda frame: key([tuple(map(cell, r)) for r in frame[columns].astype(object).itertuples(index=False)])
    assert text(got) == text(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
