"""Waveforms as a data source: arrays in files, read by time, and event windows cut from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, LessThan

from ..functions import geo

TRACE = "station string, channel string, us long, rate double, data array<double>"
#: Fixed layout of a trace line: station channel start_us rate sample sample ...


def _parsed(line: str) -> tuple | None:
    parts = line.split()
    return (parts[0], parts[1], int(parts[2]), float(parts[3]), [float(x) for x in parts[4:]]) if len(parts) >= 4 else None


class _Listed(InputPartition):
    def __init__(self, lines: list[str]) -> None:
        self.lines = lines


class _Reader(DataSourceReader):
    def __init__(self, lines: list[str], size: int) -> None:
        self.lines, self.size, self.low, self.high = lines, size, None, None

    def partitions(self) -> list[InputPartition]:
        return [_Listed(self.lines[i : i + self.size]) for i in range(0, max(1, len(self.lines)), self.size)]

    def read(self, partition: _Listed) -> Iterator[tuple]:
        for line in partition.lines:
            head = line.split(maxsplit=3)
            if len(head) < 4 or (self.low is not None and int(head[2]) < self.low) or (self.high is not None and int(head[2]) >= self.high):
                continue
            yield _parsed(line)


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds on the start time leave out lines before they are parsed."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("us",):
                self.low = f.value
            elif isinstance(f, LessThan) and f.attribute == ("us",):
                self.high = f.value
            else:
                yield f


class TraceLines(DataSource):
    """``spark.read.format("trace_lines").option("lines", text)``: trace lines given as text, for small sets
    and tests; files of any size go through :func:`read_traces`. With the option ``pushdown``, where
    spark.sql.python.filterPushdown.enabled is set, time bounds reach the reader."""

    @classmethod
    def name(cls) -> str:
        return "trace_lines"

    def schema(self) -> str:
        return TRACE

    def reader(self, schema) -> DataSourceReader:
        kind = _Pushing if self.options.get("pushdown", "false") == "true" else _Reader
        return kind([x for x in self.options.get("lines", "").split("\n") if x.strip()], int(self.options.get("partition", 1000)))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces of text files of trace lines, through Spark's reader, so files split and any store will do."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") >= 4)
    return parts.select(F.col("p")[0].alias("station"), F.col("p")[1].alias("channel"), F.col("p")[2].cast("long").alias("us"), F.col("p")[3].cast("double").alias("rate"), F.slice("p", 5, F.greatest(F.size("p") - 4, F.lit(0))).cast("array<double>").alias("data"))


def windows(events: DataFrame, traces: DataFrame, *, before: int, after: int, keys: tuple[str, ...] = ("station", "channel")) -> DataFrame:
    """idx, keys, us, rate and data of the samples of each event (idx, us) from ``before`` to ``after``
    microseconds round it, merged over the traces that touch the window (across midnight too): the
    earlier trace's sample stays where two overlap, gaps are 0. Traces meet windows by time buckets of
    the longest of both, so no pair of the two tables is made that does not touch.
    """
    from ..operators import joins as jn

    length = F.ceil(F.size("data") * 1e6 / F.col("rate")).cast("long")
    own = traces.withColumn("__len", length)
    longest = own.agg(F.max("__len")).first()[0] or 1
    met = jn.range_join(events.select("idx", F.col("us").alias("event_us")), own.withColumnRenamed("us", "trace_us"), at="event_us", time="trace_us", before=before + longest, after=after)
    met = met.filter(F.col("trace_us") + F.col("__len") > F.col("event_us") - before)
    fields = ", ".join(f"`{k}` {traces.schema[k].dataType.simpleString()}" for k in keys)

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("trace_us")
        rate = float(frame["rate"].iloc[0])
        start = int(frame["event_us"].iloc[0]) - before
        n = round((before + after) * rate / 1e6)
        out, taken = np.zeros(n), np.zeros(n, bool)
        for us, data in zip(frame["trace_us"], frame["data"], strict=True):
            at = round((us - start) * rate / 1e6) + np.arange(len(data))
            inside = (at >= 0) & (at < n)
            new = inside.copy()
            new[inside] = ~taken[at[inside]]
            out[at[new]] = np.asarray(data, float)[new]
            taken[at[new]] = True
        row = [frame["idx"].iloc[0], *(frame[k].iloc[0] for k in keys), start, rate, float(1 - taken.mean()) if n else 0.0, out]
        return pd.DataFrame([row], columns=["idx", *keys, "us", "rate", "gaps", "data"])

    kind = events.schema["idx"].dataType.simpleString()
    return met.groupBy("idx", *keys, "rate").applyInPandas(run, f"idx {kind}, {fields}, us long, rate double, gaps double, data array<double>")


def headers(events: DataFrame, stations: DataFrame, arrivals: DataFrame, *, model: str = "three_layer") -> DataFrame:
    """What an event store keeps beside each station's samples: origin, place, distance, azimuth, and the first
    P and S arrivals in seconds after the origin (picked ones, else predicted).

    events: idx, us, lat, lon, dep; stations: station, slat, slon; arrivals: idx, station, phase, pus.
    Stations that picked the event have a row.
    """
    first = arrivals.groupBy("idx", "station").agg(*(F.min(F.when(F.col("phase") == p, F.col("pus"))).alias(p) for p in "PS"))
    own = first.join(events, "idx").join(stations, "station")
    km = geo.flat_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    seconds = lambda p: (F.col(p) - F.col("us")) / 1e6
    told: list[Column] = [F.coalesce(seconds(p), geo.slant_seconds(F.col("km"), F.col("dep"), F.lit(p), model)).alias(f"{p.lower()}_seconds") for p in "PS"]
    return own.withColumn("km", km).select("idx", "station", "us", "lat", "lon", "dep", "km", geo.azimuth_deg(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("azimuth"), *told, F.col("P").isNotNull().alias("p_picked"), F.col("S").isNotNull().alias("s_picked"))


def write_store(store: DataFrame, path: str, *, shard: tuple[int, int] | None = None) -> None:
    """The event store as Parquet by event, whole or shard i of n (by a hash of the event). What is there
    already stays; a shard that was written is an error, so shards can be run apart and again."""
    own = store if shard is None else store.filter(F.pmod(F.xxhash64("idx"), F.lit(shard[1])) == shard[0])
    target = path if shard is None else f"{path}/shard={shard[0]:04d}-of-{shard[1]:04d}"
    own.repartition("idx").sortWithinPartitions("idx", "station").write.mode("errorifexists").parquet(target)
