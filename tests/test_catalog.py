"""Every query against its SQL check on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from crestline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    if name not in ORACLE:
        assert got
        return
    result = db.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == order
    index = [columns.index(c) for c in order]
    expected = sorted((tuple(plain(r[i]) for i in index) for r in result.fetchall()), key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b or all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b))
