"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}
REST = sorted(k for k in entry.queries() if k not in SQL and not k.startswith(("op", "pipeline")))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)[:26]


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([plain(v[i]) for i in order] for v in values), key=repr), [names[i] for i in order]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    made = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    got, got_names = rows(made.columns, [list(r) for r in made.collect()])
    expected, names = rows(columns, want.fetchall())
    assert got_names == names and len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-4 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", REST)
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
