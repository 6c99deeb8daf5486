"""Every query with SQL against DuckDB on the smallest tables, and the entry."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexshelf.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        made.execute(f"create view {p.stem} as select * from '{p}'")
    return made


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = frame.where(frame.notna(), None).values.tolist()
    return sorted((tuple(float(x) if isinstance(x, (int, float)) else x for x in r) for r in plain), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
