"""Pairs of points that share places."""

import numpy as np
import pandas as pd
from catalogflow.operators import joins
from catalogflow.plans import queries as core


def test_pairs_of_shared_places_are_those_of_all_points_and_dealt(spark, monkeypatch):
    core.prepare(spark)
    monkeypatch.setattr(joins, "CHUNK", 7)
    monkeypatch.setattr(joins, "CELL", 40)
    draw = np.random.default_rng(3)
    n = 400
    frame = pd.DataFrame({"id": draw.permutation(n), "x": draw.integers(0, 6, n) / 10, "y": draw.integers(0, 4, n) / 10})
    found = joins.place_pairs(spark.createDataFrame(frame), id="id", coords=["x", "y"], reach=0.125)
    want = joins.grid_pairs(spark.createDataFrame(frame), id="id", coords=["x", "y"], reach=0.125)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_crowded_places_are_not_one_task(spark):
    """2,000 stations at one place and its neighbours are small in bytes, and two million pairs."""
    core.prepare(spark)
    frame = spark.range(2_000).selectExpr("id AS s_suppkey", "0 AS s_nationkey", "0D AS s_acctbal")
    import tempfile

    folder = tempfile.mkdtemp()
    frame.write.parquet(f"{folder}/supplier.parquet")
    got = core.queries()["j22_pairs_within"](spark, folder)
    by_task = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in by_task if n) > 8 and max(by_task) < sum(by_task) / 4
