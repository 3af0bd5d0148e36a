"""Percentiles by narrowing histograms, against sorting."""

import math
import random

import pytest
from catalogflow.operators import select
from pyspark.sql import functions as F


def between(values, share):
    values = sorted(values, key=lambda v: (v != v, v))
    place = share * (len(values) - 1)
    low = math.floor(place)
    one, two = values[low], values[min(low + 1, len(values) - 1)]
    return one if place == low else one + (two - one) * (place - low)


@pytest.mark.parametrize(("share", "few", "bins"), [(0.5, 5, 4), (0.9, 1, 16), (1.0, 3, 8)])
def test_percentiles_equal_sorting(spark, monkeypatch, share, few, bins):
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "BINS", bins)
    draw = random.Random(few)
    groups = {
        "hot": [draw.gauss(0, 1) for _ in range(701)], "ties": [float(draw.randrange(3)) for _ in range(300)], "same": [2.5] * 60, "one": [7.0], None: [draw.random() for _ in range(50)],
        "wide": [draw.choice((-1, 1)) * 10.0 ** draw.uniform(-300, 300) for _ in range(80)], "ends": [math.inf, -math.inf, *[draw.random() for _ in range(30)], math.inf], "nan": [math.nan, *[draw.random() for _ in range(40)]], "two": [1.0, 4.0], "low": [0.0, 5e-324, 5e-324, 1e-323] * 10,
    }
    rows = [(k, v, 1.0) for k, values in groups.items() for v in values] + [("hot", None, 1.0), ("gone", None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, x double, low double").repartition(4)
    got = {r.k: (r.p, r.n) for r in select.percentiles(frame, keys=["k"], value="x", share=share, name="p").collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == (pytest.approx(between(values, share), nan_ok=True), len(values)), k


def test_one_group_of_all_rows(spark):
    frame = spark.range(0, 300_000, 1, 4).select(F.lit(1).alias("k"), (F.pmod(F.col("id") * 7919, F.lit(300_000)) / 3.0).alias("x"))
    assert [tuple(r) for r in select.percentiles(frame, keys=["k"], value="x", share=0.5, name="p").collect()] == [(1, pytest.approx(299_999 / 6), 300_000)]
