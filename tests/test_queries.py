"""Every core query at the smallest scale, against its SQL where it has one."""

import datetime
import importlib
import math
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def show(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(show(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        want = sorted("|".join(show(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
