"""Nearest parents by trees of boxes, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from catalogflow.operators import graph, parents


def catalog(n, seed, days):
    draw = np.random.default_rng(seed)
    t = draw.integers(0, days, n).astype(float) if days else np.round(draw.random(n) * 1e4) / 37
    x, y = (np.append(draw.integers(0, 30, n // 2) / 3, draw.normal(40, 0.5, n - n // 2)) for _ in "xy")
    return pd.DataFrame({"id": draw.permutation(n), "t": t, "x": x, "y": y, "m": np.round(draw.exponential(0.5, n), 1)})


def all_pairs(frame):
    frame = frame.sort_values("id")
    t, x, y, m = (frame[c].to_numpy() for c in "txym")
    out = {}
    for i in frame["id"].to_numpy():
        dt = t[i] - t
        r = np.maximum(np.sqrt((x[i] - x) ** 2 + (y[i] - y) ** 2), 0.01)
        with np.errstate(invalid="ignore", divide="ignore"):
            eta = np.where(dt > 0, (np.log10(dt) - 0.5 * m) + (1.6 * np.log10(r) - 0.5 * m), np.inf)
        if (dt > 0).any():
            out[i] = (eta.argmin(), pytest.approx(eta.min()))
    return out


@pytest.mark.parametrize("days", [40, 0])
def test_tiles_and_slices_tell_the_same_parents_as_all_pairs(spark, monkeypatch, days):
    monkeypatch.setattr(parents, "TILE", 150)
    monkeypatch.setattr(parents, "ASKS", 100)
    frame = catalog(2500, days + 1, days)
    got = graph.nearest_parent(spark.createDataFrame(frame), id="id", t="t", x="x", y="y", m="m").collect()
    assert {r.id: (r.parent, r.log_eta) for r in got} == all_pairs(frame)
    assert len(got) == len({r.id for r in got})


def test_few_boxes_are_followed(monkeypatch):
    followed = []
    rank = parents._rank
    monkeypatch.setattr(parents, "_rank", lambda c, by: followed.append(len(c)) or rank(c, by))
    frame = catalog(20_000, 7, 2_000)
    found = parents.search(frame.assign(bound=np.nan), frame, b=1.0, dimension=1.6, least_km=0.01, floor=1.0, scale=(2000, 50, 50))
    assert sum(followed) < 200 * len(frame)  # all pairs: 10,000 an event
    few = frame[frame["id"] < 50]
    told = found.set_index("id")["log_eta"]
    for r in few.itertuples():
        old = frame[frame["t"] < r.t]
        eta = np.log10(r.t - old["t"]) + 1.6 * np.log10(np.maximum(np.hypot(r.x - old["x"], r.y - old["y"]), 0.01)) - old["m"]
        assert told[r.id] == pytest.approx(eta.min())


def test_events_of_one_time_or_none_have_no_parents(spark):
    one = spark.createDataFrame([(i, 1.0, float(i), 0.0, 1.0) for i in range(5)], "id long, t double, x double, y double, m double")
    assert graph.nearest_parent(one, id="id", t="t", x="x", y="y", m="m").collect() == []
    assert graph.nearest_parent(one.filter("id < 0"), id="id", t="t", x="x", y="y", m="m").collect() == []
