"""Every registered query with SQL gives DuckDB's rows on the same tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from quern.plans import registry


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_rows(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toArrow(), duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    rows = lambda t: sorted(repr([plain(r[c]) for c in columns]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 20  # the small tables lack documents of some vectors
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
