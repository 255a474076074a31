"""Every registered query of the library's own operators runs, and gives the rows of its SQL."""

import datetime as dt
import math

import duckdb
import pytest

from arealis.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, dt.datetime) and v.time() == dt.time():
        return v.date()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def rows(names, found):
    """Rows with their columns by name, in order of their exact values and then of their floats, coarsely."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in found]
    return sorted(out, key=lambda r: repr([f"{v:.3f}" if isinstance(v, float) else v for v in r]))


def alike(a, b):
    """Equal, or floats that differ by less than the last digit that queries print."""
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    got = rows(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert len(g) == len(w) and all(alike(a, b) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    found = df.collect()
    assert found and all(v is None or not isinstance(v, float) or math.isfinite(v) for r in found for v in r)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
