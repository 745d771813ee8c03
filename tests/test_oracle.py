"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not there")
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")


def plain(v):
    return "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = db.sql(entry.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
