"""Every query with a DuckDB text gives the same columns, types and rows."""

import math

import duckdb
import pytest

from registry import load
from registry.book import ORACLES, QUERIES
from registry.fixtures import TABLES
from tests.conftest import DATA

load()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, v + 0.0) if isinstance(v, float) else (2, str(v))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    duck.execute(f"create or replace temp view oracle as {ORACLES[name]}")
    kinds = {r[0]: r[1] for r in duck.execute("describe select * from oracle").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    order = sorted(kinds)
    ours = sorted([tuple(map(_cell, r)) for r in df.select(*[f"`{c}`" for c in order]).collect()])
    text = "select " + ", ".join(f'"{c}"' for c in order) + " from oracle"
    theirs = sorted([tuple(map(_cell, r)) for r in duck.execute(text).fetchall()])
    assert len(ours) == len(theirs) and len(ours) > 0
    assert ours == theirs
