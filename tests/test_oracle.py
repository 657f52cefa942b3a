"""Every query with SQL gives DuckDB's rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from skeinql.workload import analyses, queries

QUERIES = queries.QUERIES
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_are_those_of_the_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(value(r[n]) for n in names) for r in df.collect())
    out = duck.execute(queries.SQL[name])
    own = [d[0] for d in out.description]
    assert sorted(own) == names
    want = Counter(tuple(value(r[own.index(n)]) for n in names) for r in out.fetchall())
    assert got == want
    assert got or name in ("dont_catch",)
