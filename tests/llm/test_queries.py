"""Every query opN_<name> on the smallest tables, against its SQL on DuckDB where it has any."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lexshelf.llm import queries

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


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        want = con.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got) == con.execute("select count(*) from documents").fetchone()[0] or name == "op5_pack"
