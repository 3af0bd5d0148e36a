"""The stages of a catalog on the user's own files: detection, association, augmentation, readiness, coherence,
export, relocation in batches. Each is a function that the command line calls and that returns what it did."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..operators import associate as asc
from ..operators import detect, robust
from ..operators import windows as wn
from ..sources import tables, waveforms
from . import augment as aug

#: Stations that the driver may hold, as a map of places.
MOST_STATIONS = 100_000
STAGES = ("detect", "associate", "augment", "ready")
KM_NORTH, KM_EAST = 110.574, 111.32


def _stations(spark: SparkSession, path: str) -> DataFrame:
    """station, slat, slon of a station list."""
    return tables.read_stations(spark, path).select(F.concat_ws(".", "Network", "Code").alias("station"), F.col("Latitude").alias("slat"), F.col("Longitude").alias("slon"))


def _fresh(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def detect_year(spark: SparkSession, traces: str, folder: str, year: int, *, days: Sequence[int] | None = None, least: float = 0.3, picker: detect.Picker | None = None, skip: bool = True) -> dict:
    """Daily pick files of a year from trace files, one folder a day. Days whose file is there are left out
    unless ``skip`` is false."""
    found = detect.pick(waveforms.read_traces(spark, traces), picker or detect.energy_ratio(), least=least)
    at = F.timestamp_micros("us")
    own = found.select("station", "phase", at.alias("peak_time"), "probability", F.year(at).alias("__y"), F.dayofyear(at).alias("__d")).filter(F.col("__y") == year).checkpoint()
    counts = {r[0]: r[1] for r in own.groupBy("__d").count().collect()}
    done = {}
    for day in sorted(counts if days is None else set(days) & set(counts)):
        path = f"{folder}/picks_{year}.{day:03d}.csv"
        if skip and not _fresh(spark, path):
            continue
        tables.replace_csv(own.filter(F.col("__d") == day).select("station", "phase", "peak_time", "probability"), path)
        done[day] = counts[day]
    return {"days": done, "picks": sum(done.values())}


def associate_year(spark: SparkSession, folder: str, stations: str, out: str, year: int, *, gate: Mapping[str, float] = asc.GATE, least: float = 0.3, overlap_s: int = 150, step_km: float = 10.0, tolerance_s: float = 1.5, speed: Mapping[str, float] = {"P": 6.0, "S": 3.5}) -> dict:
    """events_<year>.csv and assignments_<year>.csv from the year's picks. Stations stand in km round their
    middle; picks of unlisted stations are counted and left out."""
    sta = _stations(spark, stations).checkpoint()
    if sta.count() > MOST_STATIONS:
        raise ValueError(f"more than {MOST_STATIONS} stations")
    known = {r.station: (r.slat, r.slon) for r in sta.collect()}
    if not known:
        raise ValueError(f"no station in {stations}")
    lat0, lon0 = (sum(p[i] for p in known.values()) / len(known) for i in (0, 1))
    east = KM_EAST * math.cos(math.radians(lat0))
    places = {s: ((lon - lon0) * east, (lat - lat0) * KM_NORTH) for s, (lat, lon) in known.items()}
    picks = tables.read_picks(spark, folder, year).filter(F.col("probability") >= least)
    picks = wn.first_by(picks, ["station", "phase", "peak_time"], [F.desc("probability")]).withColumn("us", F.unix_micros("peak_time"))
    picks = picks.withColumn("pick_id", F.xxhash64("station", "phase", "us")).checkpoint()
    listed = picks.join(F.broadcast(sta.select("station")), "station", "left_semi")
    run = asc.grid_associator(places, speed=speed, step=step_km, tolerance=tolerance_s, least=int(gate.get("n_picks", 4)))
    events, assigned = asc.associate(listed.select("pick_id", "station", "phase", "us"), run, overlap=overlap_s * 1_000_000, gate=gate)
    events = events.checkpoint()
    e = events.select(F.col("global_id").alias("idx"), F.timestamp_micros("us").alias("time"), "x", "y", F.lit(0.0).alias("z"), F.col("n_picks").cast("int").alias("picks"), (F.lit(lat0) + F.col("y") / KM_NORTH).alias("latitude"), (F.lit(lon0) + F.col("x") / east).alias("longitude"), F.lit(0.0).alias("depth"))
    a = assigned.join(listed.select("pick_id", "us"), "pick_id").select("event_idx", F.col("pick_id").alias("pick_idx"), "residual", text.with_dot(F.col("station")).alias("station"), "phase", (F.col("us") / 1e6).alias("time"))
    tables.replace_csv(e, f"{out}/events_{year}.csv")
    tables.replace_csv(a, f"{out}/assignments_{year}.csv")
    total, there = picks.count(), listed.count()
    return {"picks": total, "unlisted": total - there, "events": events.count(), "assigned": spark.read.option("header", True).csv(f"{out}/assignments_{year}.csv").count()}


def augment_year(spark: SparkSession, folder: str, out: str, stations: str, year: int, *, radius_km: float = 100.0, tolerance_s: float = 1.0, least: float = 0.3, tie_s: float = 0.2, model: str = "three_layer") -> dict:
    """Adds the picks that fit an event to the year's assignments and swaps the file; the old one stays as a
    backup. Returns counts: events, assignments before, added (by phase), ambiguous, and the backup's path. A
    year without files does nothing."""
    events, assigned = tables.read_year(spark, out, year)
    if events is None:
        return {"year": year, "status": "missing"}
    sta = _stations(spark, stations)
    e = events.select("idx", F.unix_micros("time").alias("us"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.coalesce("depth", F.lit(0.0)).alias("dep"))
    a = assigned.select(F.col("event_idx").alias("idx"), F.col("pick_idx").alias("pick_id"), "station", "phase", "residual", "time").checkpoint()
    p = tables.read_picks(spark, folder, year).withColumn("pus", F.unix_micros("peak_time"))
    p = p.select(F.xxhash64("station", "phase", "pus").alias("pick_id"), "station", "phase", F.col("phase").alias("kind"), "pus", F.col("probability").alias("prob")).dropDuplicates(["pick_id"])
    free = p.join(a.select("pick_id"), "pick_id", "left_anti")
    every, decided = aug.augment(e, a, sta, free, tie=tie_s, radius=radius_km, tolerance=tolerance_s, least=least, model=model)
    every = every.join(p.select("pick_id", F.col("pus").alias("__us")), "pick_id", "left").checkpoint()
    added = {r[0]: r[1] for r in every.filter("source = 'augmented'").groupBy("phase").count().collect()}
    final = every.select(F.col("idx").alias("event_idx"), F.col("pick_id").alias("pick_idx"), "residual", text.with_dot(F.col("station")).alias("station"), "phase", F.coalesce("time", F.col("__us") / 1e6).alias("time"))
    ambiguous = decided.filter("decision = 'dropped_ambiguous'").count()
    before = a.count()
    backup = tables.replace_csv(final, f"{out}/assignments_{year}.csv")
    return {"year": year, "status": "done", "events": e.count(), "before": before, "added": sum(added.values()), "added_by_phase": added, "ambiguous": ambiguous, "backup": backup}


def coherence(catalog: DataFrame, picks: DataFrame, stations: DataFrame, *, least_p: float = 0.3, window_s: float = 60.0, least: int = 5, inlier_s: float = 1.0, inlier_min: float = 0.5) -> DataFrame:
    """``catalog`` (event_key, time, lat, lon, any others) with mv_nP, mv_app (km/s), mv_rms, mv_rho, mv_inlier
    and coherence_fail: do the first P picks after an event move out from where it is said to be?

    The earliest P of each station within ``window_s`` meets the event by time buckets; arrival over distance
    is fitted by Theil-Sen. Events of fewer than ``least`` stations have nulls and do not fail.
    """
    from ..operators import joins as jn

    e = catalog.select("event_key", F.unix_micros("time").alias("us"), "lat", "lon")
    p = picks.filter((F.col("phase") == "P") & (F.col("probability") >= least_p)).select("station", F.unix_micros("peak_time").alias("pus"))
    met = jn.range_join(e, p, at="us", time="pus", before=0, after=round(window_s * 1e6))
    first = met.groupBy("event_key", "us", "lat", "lon", "station").agg(F.min("pus").alias("pus")).join(stations, "station")
    own = first.select("event_key", "station", geo.flat_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("km"), ((F.col("pus") - F.min("pus").over(Window.partitionBy("event_key"))) / 1e6).alias("s"))
    fit = robust.theil_sen(own, keys=["event_key"], id="station", x="km", y="s", inlier=inlier_s, least=least)
    fit = fit.select("event_key", F.col("n").alias("mv_nP"), F.when(F.col("slope") > 1e-6, 1 / F.col("slope")).otherwise(99.0).alias("mv_app"), F.col("rms").alias("mv_rms"), F.col("rho").alias("mv_rho"), F.col("inlier").alias("mv_inlier"))
    return catalog.join(fit, "event_key", "left").withColumn("coherence_fail", F.coalesce(F.col("mv_inlier") < inlier_min, F.lit(False)))


def coherence_files(spark: SparkSession, catalog: str, folder: str, stations: str, *, years: Sequence[int], inlier_min: float = 0.5, out_scored: str | None = None, out_clean: str | None = None, out_audit: str | None = None) -> dict:
    cat = tables.read_catalog(spark, catalog)
    cat = cat.withColumnsRenamed({a: b for a, b in (("latitude", "lat"), ("longitude", "lon")) if a in cat.columns and b not in cat.columns})
    picks = None
    for year in years:
        own = tables.read_picks(spark, folder, year)
        picks = own if picks is None else picks.unionByName(own)
    scored = coherence(cat, picks, _stations(spark, stations), inlier_min=inlier_min).checkpoint()
    for path, frame in ((out_scored, scored), (out_clean, scored.filter("NOT coherence_fail").drop("coherence_fail")), (out_audit, scored.filter("coherence_fail"))):
        if path:
            tables.replace_csv(frame, path)
    told = scored.agg(F.count("*").alias("events"), F.count("mv_nP").alias("testable"), F.count_if("coherence_fail").alias("flagged")).first()
    return told.asDict()


def readiness(spark: SparkSession, folder: str, out: str, year: int) -> dict:
    """How far a year is: rows and days of each stage, and READY or what is missing."""
    try:
        picks = tables.read_picks(spark, folder, year)
        told = picks.agg(F.count("*").alias("picks"), F.count_distinct(F.to_date("peak_time")).alias("days")).first().asDict()
    except FileNotFoundError:
        told = {"picks": 0, "days": 0}
    events, assigned = tables.read_year(spark, out, year)
    told["events"] = events.count() if events is not None else 0
    told["assigned"] = assigned.count() if assigned is not None else 0
    told["orphaned"] = assigned.join(events.select(F.col("idx").alias("event_idx")), "event_idx", "left_anti").count() if events is not None else 0
    missing = [k for k in ("picks", "events", "assigned") if not told[k]] + (["consistent ids"] if told["orphaned"] else [])
    return {"year": year, **told, "status": "READY" if not missing else f"incomplete: {', '.join(missing)}"}


def run_years(spark: SparkSession, years: Sequence[int], *, folder: str, out: str, stations: str, traces: str | None = None, stage_from: str = STAGES[0], through: str = STAGES[-1], strict: bool = False, gate: Mapping[str, float] = asc.GATE) -> list[dict]:
    """The stages of each year, from one to another; a year that fails is told and, unless ``strict``, the
    next goes on. Detection needs traces and is left out without them."""
    wanted = STAGES[STAGES.index(stage_from) : STAGES.index(through) + 1]
    told = []
    for year in years:
        own: dict = {"year": year}
        try:
            if "detect" in wanted and traces:
                own["detect"] = detect_year(spark, traces, folder, year)
            if "associate" in wanted:
                own["associate"] = associate_year(spark, folder, stations, out, year, gate=gate)
            if "augment" in wanted:
                own["augment"] = augment_year(spark, folder, out, stations, year)
            if "ready" in wanted:
                own["ready"] = readiness(spark, folder, out, year)
        except (FileNotFoundError, ValueError) as e:
            if strict:
                raise
            own["failed"] = str(e)
        told.append(own)
    return told


def relocate_batch(spark: SparkSession, families: DataFrame, solver: Callable[[pd.DataFrame], pd.DataFrame], schema: str, manifest: str, *, limit: int | None = None, redo: bool = False) -> DataFrame:
    """What ``solver`` makes of each family (family, ...) that the manifest does not have yet, the largest
    first and ``limit`` of them at most; the manifest, a Parquet folder, gets a row for each, so a run that
    stopped goes on where it was."""
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    if not redo and not _fresh(spark, manifest):
        sizes = sizes.join(spark.read.parquet(manifest).select("family"), "family", "left_anti")
    chosen = sizes if limit is None else sizes.orderBy(F.desc("n"), "family").limit(limit)
    chosen = chosen.checkpoint()
    found = families.join(chosen.select("family"), "family", "left_semi").groupBy("family").applyInPandas(solver, schema).checkpoint()
    chosen.withColumn("done_at", F.current_timestamp()).write.mode("append").parquet(manifest)
    return found
