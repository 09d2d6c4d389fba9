"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest

from stratal import catalogue, plans

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = duck.sql(catalogue.oracle_sql()[name])
    order = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == sorted(tuple(norm(r[k]) for k in order) for r in want.fetchall())


def test_names_are_registered_once():
    with pytest.raises(ValueError):
        catalogue.register("daily_seal")(lambda spark, sf: None)
