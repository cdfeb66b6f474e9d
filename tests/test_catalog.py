"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from recallgrid import catalog, catalog_upkeep  # noqa: F401 - registers its queries

duckdb = pytest.importorskip("duckdb")
TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(TABLES.glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(columns, found):
    """Rows in any order, columns by name, numbers to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{round(float(v), 6) + 0.0:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(TABLES))
    want = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
