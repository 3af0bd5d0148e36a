"""Instrument responses: gain by frequency from poles and zeros, and responses derived for stations without one."""

from __future__ import annotations

import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the response text: the line of the first day, and what a derived text begins with.
START_LINE, START = "B052F22", "B052F22     Start date:  "
MARKER = "#\t\tDERIVED"


def log_gain(frequency: Column, zeros: Column, poles: Column, factor: Column) -> Column:
    """Common logarithm of the gain at a frequency in Hz: factor * prod |jw - z| / prod |jw - p|, of arrays of
    (re, im). Sums of logarithms, so no product leaves the range; null where a zero lies on the frequency."""
    w = 2 * math.pi * frequency
    far = lambda x: F.log10(F.hypot(x["re"], w - x["im"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + far(x))
    return F.log10(factor) + total(zeros) - total(poles)


def phase(frequency: Column, zeros: Column, poles: Column) -> Column:
    """Degrees from -180 (not included) to 180 by which the response is ahead at a frequency in Hz."""
    w = 2 * math.pi * frequency
    turn = lambda x: F.atan2(w - x["im"], -x["re"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + turn(x))
    degrees = F.degrees(total(zeros) - total(poles))
    return F.lit(180.0) - F.pmod(F.lit(180.0) - degrees, F.lit(360.0))


def merged(sources: list[DataFrame], *, keys: tuple[str, ...] = ("network", "station", "channel")) -> DataFrame:
    """The rows of all sources, those of an earlier source in place of a later one's of the same keys."""
    out = None
    for k, source in enumerate(sources):
        own = source.withColumn("__source", F.lit(k))
        out = own if out is None else out.unionByName(own)
    names = [c for c in out.columns if c not in (*keys, "__source")]
    best = out.groupBy(*keys).agg(F.min(F.struct("__source", *names)).alias("__best"))
    return best.select(*keys, *(F.col("__best")[c].alias(c) for c in names), F.col("__best.__source").alias("source"))


def derived(responses: DataFrame, needed: DataFrame, available: DataFrame, *, template: str | None = None) -> DataFrame:
    """network, station, channel, first, text and status for each station of ``needed`` (station) that has no
    response: the text of the ``template`` station (the first one, if none is named) under its own code, valid
    from its first day with data. It is marked as derived.

    responses: network, station, channel, text; available: station, day. A station without a day cannot be
    given a start: one row with status no_data and no text.
    """
    if template is None:
        template = responses.agg(F.min("station")).first()[0]
    missing = needed.select("station").distinct().join(responses.select("station"), "station", "left_anti")
    first = available.groupBy("station").agg(F.min("day").alias("first"))
    asked = missing.join(first, "station", "left").withColumn("template", F.lit(template))
    # the channels of one station
    given = responses.filter(F.col("station") == F.lit(template)).select("network", F.col("station").alias("template"), "channel", "text")
    found = asked.filter("first IS NOT NULL").join(F.broadcast(given), "template")
    start = F.concat(F.lit(START), F.date_format("first", "yyyy,DDD"))
    body = F.regexp_replace(F.replace("text", F.col("template"), F.col("station")), F.lit(f"(?m)^{START_LINE}.*$"), start)
    head = F.concat(F.lit(f"{MARKER} from RESP."), "network", F.lit("."), "template", F.lit(".."), "channel", F.lit("\n#\t\tstart date = "), "station", F.lit(" first day with data; NOT authoritative metadata\n"))
    told = found.select("network", "station", "channel", "first", F.concat(head, body).alias("text"), F.lit("derived").alias("status"))
    null = F.lit(None).cast("string")
    gone = asked.filter("first IS NULL").select(null.alias("network"), "station", null.alias("channel"), "first", null.alias("text"), F.lit("no_data").alias("status"))
    return told.unionByName(gone)


def write_responses(found: DataFrame, path: str, *, dry_run: bool = False) -> DataFrame:
    """(file, bytes) of the texts of :func:`derived`, written as RESP.NET.STA..CHA under ``path``, a folder
    that driver and executors mount; with ``dry_run`` nothing is written."""
    root = path.removeprefix("file://").removeprefix("file:")
    named = found.filter("text IS NOT NULL").select(F.concat(F.lit("RESP."), "network", F.lit("."), "station", F.lit(".."), "channel").alias("file"), "text")
    if dry_run:
        return named.select("file", F.octet_length("text").cast("long").alias("bytes"))

    def run(frames):
        os.makedirs(root, exist_ok=True)
        for frame in frames:
            for name, text in zip(frame["file"], frame["text"], strict=True):
                place = os.path.join(root, name)
                with open(f"{place}.{os.getpid()}.part", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(f"{place}.{os.getpid()}.part", place)
            yield pd.DataFrame({"file": frame["file"], "bytes": [len(t.encode()) for t in frame["text"]]})

    return named.mapInPandas(run, "file string, bytes long")
