"""Pipelines that recover picks for located events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins as jn
from ..operators import windows as wn


def nearest_stations(events: DataFrame, stations: DataFrame, *, n: int, id: str = "id", event: str = "idx") -> DataFrame:
    """The ``n`` stations (slat, slon) nearest to each event (lat, lon), all columns and ``km``; ties go to
    the smaller id.

    Events meet the stations of the cells round their own. Those whose n-th distance is not less than a
    cell's width, beyond which a station may have been missed, go on with cells of twice the width.
    """
    own = jn.top(stations, [F.col("slat"), F.col("slon")], [F.col(id)], n).checkpoint()
    box = own.agg(F.count_distinct("slat", "slon").alias("n"), *(f(c) for c in ("slat", "slon") for f in (F.min, F.max))).first()
    if not box.n:
        return events.join(own.limit(0).withColumn("km", F.lit(0.0)), F.lit(False))
    width = min(180.0, max(1e-4, math.sqrt(max(box[2] - box[1], 1e-4) * max(box[4] - box[3], 1e-4) * n / box.n)))
    open_, found = events.checkpoint(), None
    while True:
        last = width >= 180
        around = max(1, math.floor(360 / width))  # cells round the globe, at least as wide as ``width``
        row, col = (lambda c: F.floor(F.col(c) / width)), (lambda c: F.floor(F.pmod(F.col(c), F.lit(360.0)) / (360 / around)))
        if last:
            row = col = lambda c: F.lit(0).cast("long")
            asked = open_.withColumns({"__i": row("lat"), "__j": col("lon")})
        else:
            asked = open_.withColumn("__i", F.explode(F.array(*(row("lat") + k for k in (-1, 0, 1))))).withColumn("__j", F.explode(F.array_distinct(F.array(*(F.pmod(col("lon") + k, F.lit(around)) for k in (-1, 0, 1))))))
        km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
        pairs = asked.join(own.withColumns({"__i": row("slat"), "__j": F.pmod(col("slon"), F.lit(around))}), ["__i", "__j"]).drop("__i", "__j").withColumn("km", km)
        best = jn.top(pairs, [F.col(event)], [F.col("km"), F.col(id)], n)
        if last:
            return best if found is None else found.unionByName(best)
        # a station outside differs by a width in latitude or longitude at least; cells do not reach over a pole
        sure = 0.999999 * geo.EARTH_KM * F.least(F.radians(F.lit(width)), F.asin(F.cos(F.radians(F.col("lat"))) * math.sin(math.radians(min(width, 90.0)))))
        best = best.checkpoint()
        done = best.groupBy(event).agg(F.count("*").alias("__n"), F.max(F.col("km") - sure).alias("__over")).filter((F.col("__n") == n) & (F.col("__over") < 0)).select(event).checkpoint()
        sound = best.join(done, event, "left_semi")
        found = sound if found is None else found.unionByName(sound)
        open_ = open_.join(done, event, "left_anti").checkpoint()
        if open_.isEmpty():
            return found
        width *= 2


def candidates(events: DataFrame, assigned: DataFrame | None, stations: DataFrame, picks: DataFrame, *, least: float = 0.3, radius: float = 100.0, tolerance: float = 1.0, before: int = 5_000_000, after: int = 120_000_000, model: str = "three_layer", stretch: float = 1.0, unless: Column | None = None, rivals: str | None = None) -> DataFrame:
    """Picks that fit an event's predicted arrival within ``tolerance`` seconds and are not yet its.

    events: idx, us, lat, lon, dep; assigned: idx, station, phase; stations: station, slat, slon; picks:
    pick_id, station, phase, kind (P or S), pus, prob. Picks of unknown stations do not fit. ``stretch``
    multiplies travel times. ``unless``, a condition on columns of both sides, tells assigned ones without a
    join of the pairs. ``rivals`` names an array of the other picks (pus, pick_id) of a pick's station and phase that
    are at most two tolerances from it: of those that fit an event, the one that fits best stays (ties: the smaller
    pick_id), and no pair is shuffled for it. Returns idx, pick_id, station, phase, residual, epi, prob.
    """
    sound = picks.filter(F.col("prob") >= least).join(stations, "station")
    pairs = jn.range_join(events, sound, at="us", time="pus", before=before, after=after)
    epi = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    late = lambda pus: (pus - F.col("us")) / 1e6 - F.col("__travel")
    travel = stretch * geo.slant_seconds(F.col("epi"), F.col("dep"), F.col("kind"), model)
    if unless is not None:
        pairs = pairs.filter(~unless)
    fit = pairs.withColumn("epi", epi).filter(F.col("epi") <= radius).withColumn("__travel", travel).withColumn("residual", late(F.col("pus"))).filter(F.abs("residual") <= tolerance)
    if rivals is not None:
        order = lambda pus, pick: F.struct(F.abs(late(pus)), pick, pus)
        better = lambda r: r.pus.between(F.col("us") - before, F.col("us") + after) & (order(r.pus, r.pick_id) < order(F.col("pus"), F.col("pick_id")))
        fit = fit.filter(~F.exists(rivals, better))
    if assigned is not None:
        fit = fit.join(assigned.select("idx", "station", "phase"), ["idx", "station", "phase"], "left_anti")
    return fit.select("idx", "pick_id", "station", "phase", "residual", "epi", "prob")


def augment(events: DataFrame, assigned: DataFrame, stations: DataFrame, picks: DataFrame, *, tie: float = 0.2, **kind) -> tuple[DataFrame, DataFrame]:
    """Assignments with the picks recovered (``source`` tells them apart) and the decisions on picks
    that fit several events. No assignment is lost; a pick joins one event at most."""
    found = candidates(events, assigned, stations, picks, **kind)
    clear, decided = wn.resolve_ambiguous(found, pick=["station", "phase", "pick_id"], residual="residual", event="idx", tie=tie)
    new = wn.first_by(clear, ["idx", "station", "phase"], [F.abs("residual"), F.col("pick_id")])
    old = assigned.withColumn("source", F.lit("associated"))
    return old.unionByName(new.withColumn("source", F.lit("augmented")), allowMissingColumns=True), decided
