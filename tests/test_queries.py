import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from wordloom.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t[:-8]} as select * from '{D}/{t}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("wordloom.llm"):
        assert {"pipeline"} <= set(entry.queries()) and sum(k.startswith("op") and k[2].isdigit() for k in entry.queries()) == 10


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, db, name):
    got, want = registry.queries()[name](spark, D), db.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    key = lambda t: [(x is None, x if x is not None else 0) for x in t]
    a = sorted((tuple(r[c] for c in names) for r in got.collect()), key=key)
    b = sorted((tuple(x) for x in want.project(", ".join(f'"{c}"' for c in names)).fetchall()), key=key)
    assert len(a) == len(b) and all(x == y or all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9) for p, q in zip(x, y)) for x, y in zip(a, b))


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, D).count() > 0, name


def test_gray_inverse_is_its_sql_on_wider_words(spark, tmp_path):
    """Part keys of larger tables don't fit the 16 bits of the stream; its SQL keeps their further bits."""
    rows = ", ".join(f"({i}, {w}::BIGINT, 0, 1, 1.0, DATE '1995-01-01')" for i, w in enumerate((0, 1, 65535, 65536, 119999, 1200000)))
    c = duckdb.connect()
    c.sql(f"create table lineitem as select * from (values {rows}) t({', '.join(registry.L_KEY)})")
    c.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    got = registry.queries()["map_gray_inv"](spark, str(tmp_path)).select("pos", "word").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(registry.oracle_sql()["map_gray_inv"]).fetchall())
