"""Association of picks with events, chunk by chunk: days with an overlap, a gate, ids over all days.

The wrapper is relational; the associator of a chunk is a function from a frame of picks to one of
events and one of assignments. A small grid search is here; any other can be passed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import DAY_US
from . import windows as wn

#: Fixed names of the gate: least picks, P picks, S picks, stations with both; and their defaults.
GATE = {"n_picks": 4, "n_p": 2, "n_s": 2, "n_ps": 1}
FOUND = "day long, event long, us long, x double, y double, pick_id long, residual double"


def in_chunks(picks: DataFrame, *, overlap: int) -> DataFrame:
    """Each pick in the day it falls in and in the neighbouring day whose overlap it is in."""
    near = F.array_distinct(F.array(*(F.floor((F.col("us") + d) / DAY_US) for d in (0, -overlap, overlap))))
    return picks.withColumn("day", F.explode(near))


def grid_associator(stations: Mapping[str, tuple[float, float]] | Callable[[str], tuple[float, float]], *, speed: Mapping[str, float], step: float, tolerance: float, least: int, box: tuple[tuple[float, float], tuple[float, float]] | None = None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Back-projects picks on a grid: the node and time with most picks is an event, whose picks leave;
    until fewer than ``least`` agree. ``stations`` has the places, or is a function from any station's
    code to its place; the grid then spans ``box``. Picks of stations that a mapping lacks have no place."""
    listed = not callable(stations)
    place_of = stations.__getitem__ if listed else stations
    xy = np.array(box or list(stations.values()))
    lows, highs = xy.min(axis=0), xy.max(axis=0)
    nodes = np.array([(x, y) for x in np.arange(lows[0], highs[0] + step, step) for y in np.arange(lows[1], highs[1] + step, step)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = (frame[frame["station"].isin(list(stations))] if listed else frame).sort_values("us")
        place = np.array([place_of(s) for s in own["station"]]).reshape(-1, 2)
        t = own["us"].to_numpy(np.int64) / 1e6
        v = np.array([speed[p] for p in own["phase"]])
        travel = np.hypot(place[:, None, 0] - nodes[None, :, 0], place[:, None, 1] - nodes[None, :, 1]) / v[:, None]
        free, out, event = np.ones(len(own), bool), [], 0
        while free.sum() >= least:
            best = (0, None)
            for n in range(len(nodes)):
                origin = np.sort((t - travel[:, n])[free])
                count = np.searchsorted(origin, origin + 2 * tolerance, "right") - np.arange(len(origin))
                k = int(count.argmax())
                if count[k] > best[0]:
                    best = (int(count[k]), (n, origin[k] + tolerance))
            if best[0] < least:
                break
            n, at = best[1]
            hit = free & (np.abs(t - travel[:, n] - at) <= tolerance + 1e-9)
            for i in np.flatnonzero(hit):
                out.append((int(frame["day"].iloc[0]), event, int(at * 1e6), nodes[n, 0], nodes[n, 1], int(own["pick_id"].iloc[i]), float(t[i] - travel[i, n] - at)))
            free &= ~hit
            event += 1
        return pd.DataFrame(out, columns=["day", "event", "us", "x", "y", "pick_id", "residual"])

    return run


def associate(picks: DataFrame, associator: Callable[[pd.DataFrame], pd.DataFrame], *, overlap: int = 150_000_000, gate: Mapping[str, int] = GATE) -> tuple[DataFrame, DataFrame]:
    """Events and assignments of picks (pick_id, station, phase, us).

    Each day is associated with its overlap; an event stays if it falls in its own day and passes the
    gate. Global ids go up by day. One task works on one day's picks.
    """
    found = in_chunks(picks, overlap=overlap).groupBy("day").applyInPandas(associator, FOUND).checkpoint()
    inside = found.filter(F.floor(F.col("us") / DAY_US) == F.col("day")).join(picks.select("pick_id", "station", "phase"), "pick_id")
    both = inside.groupBy("day", "event", "station").agg(F.count_distinct("phase").alias("k")).groupBy("day", "event").agg(F.count_if(F.col("k") >= 2).alias("n_ps"))
    counts = inside.groupBy("day", "event", "us", "x", "y").agg(F.count("*").alias("n_picks"), F.count_if(F.col("phase") == "P").alias("n_p"), F.count_if(F.col("phase") == "S").alias("n_s")).join(both, ["day", "event"])
    for name, least in {**GATE, **gate}.items():
        counts = counts.filter(F.col(name) >= least)
    events = wn.global_index(counts, group="day", local="event")
    return events, inside.join(events.select("day", "event", "global_id"), ["day", "event"]).select(F.col("global_id").alias("event_idx"), "pick_id", "station", "phase", "residual")
