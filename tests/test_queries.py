"""Every query with an SQL twin gives the twin's rows on the smallest tables; the others run."""

import os

import duckdb
import pytest

from textloom.plans.catalog import ORACLES, QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, DATA)
    found = got.collect()
    if name in ORACLES:
        twin = sql.execute(ORACLES[name])
        names = [c[0] for c in twin.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, found) == rows(names, twin.fetchall())
