"""Operators that have SQL agree with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from civicframe.llm.registry import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not there")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    expected = db.sql(oracle_sql()[name])
    assert columns == sorted(expected.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(expected.select(*[f'"{c}"' for c in columns]).fetchall())
