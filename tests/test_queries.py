"""Every registered query of the library against its SQL in DuckDB, on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tonalframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_tuple"):
        x = float(x)
    return round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr)
    assert got
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == names
        want = sorted((plain(r) for r in found.select(*[f'"{n}"' for n in names]).fetchall()), key=repr)
        assert got == want


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
