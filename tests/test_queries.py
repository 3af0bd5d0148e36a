"""Every registered query of the library against its SQL in DuckDB, over whole small tables."""

import math
from collections import Counter

import duckdb
import pytest
from catalogflow.plans import queries as core

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"w20_change_points", "c17_association", "c10_density_tree"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    if name in SLOW:
        pytest.skip("covered by its own test")
    core.prepare(spark)
    frame = core.queries()[name](spark, SF)
    got = frame.collect()
    if name not in core.oracle_sql():
        assert len(frame.columns) > 0
        return
    found = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows(frame.columns, got) == rows(names, found.fetchall())
