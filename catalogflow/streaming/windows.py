"""Daily chunks, sliding windows, sessions and late picks on streams.

Each function works on a stream and on a table alike, so that a stream that has ended equals the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a frame of numbered ids holds.
GATHERED = 50_000
#: Rows of a bucket that one row of a join holds, and pairs that leave it at once, about.
PACK, PAIRS = 10_000, 1_000_000


def daily_counts(picks: DataFrame, *, at: str = "ts", keys: tuple[str, ...] = (), late: str = "10 minutes") -> DataFrame:
    """Counts by day; a day is final once the watermark has passed its end."""
    w = F.window(at, "1 day")
    return picks.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), *keys, "n")


def with_overlap(picks: DataFrame, *, at: str = "ts", overlap_s: int = 150) -> DataFrame:
    """Each pick in its day and in the neighbour whose overlap it is in (``day``: the start)."""
    days = F.array_distinct(F.array(*(F.date_trunc("day", F.col(at) + F.make_dt_interval(secs=F.lit(float(s)))) for s in (0, -overlap_s, overlap_s))))
    return picks.withColumn("day", F.explode(days))


def sliding(events: DataFrame, *aggregates: Column, at: str = "ts", width: str = "730 days", step: str = "183 days", late: str = "1 day") -> DataFrame:
    w = F.window(at, width, step)
    return events.withWatermark(at, late).groupBy(w).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in _names(aggregates)])


def _names(columns: tuple[Column, ...]) -> list[str]:
    return [c._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for c in columns]


def bursts(events: DataFrame, *, at: str = "ts", keys: tuple[str, ...] = (), gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions: runs of events not more than a gap apart."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once(picks: DataFrame, *, id: str = "pick_id", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each pick once within the watermark: a source that is read again adds nothing."""
    return picks.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


def _packs(rows: DataFrame, id: str) -> DataFrame:
    """Rows (b, id, us) of a batch and bucket as one row (b, ids, us, last), in order of time; of more than PACK, as
    several."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(frames)
        if not sum(map(len, own)):
            return
        whole = pd.concat(own, ignore_index=True).sort_values(["b", "us"], ignore_index=True)
        place = whole.groupby("b").cumcount().to_numpy()
        first = np.flatnonzero(place % PACK == 0)
        ids, us = np.split(whole[id].to_numpy(), first[1:]), np.split(whole["us"].to_numpy(), first[1:])
        yield pd.DataFrame({"b": whole["b"].to_numpy()[first], "ids": ids, "us": us, "last": [u[-1] for u in us]})

    packed = rows.select("b", id, "us").filter("b IS NOT NULL").repartition("b").mapInPandas(run, f"b long, ids array<{rows.schema[id].dataType.simpleString()}>, us array<long>, last long")
    return packed.withColumn("last", F.timestamp_micros("last"))


def late_picks(origins: DataFrame, picks: DataFrame, *, after_s: int = 120, before_s: int = 5, late: str = "10 minutes") -> DataFrame:
    """Stream-stream interval join of origins (idx, ts) and picks (pick_id, ts), both with watermarks, so
    the state holds no more than the interval and the lateness. Streams join on an equality: the time
    buckets that an origin's interval touches. What a batch brings to a bucket is a row of either side, so the state
    is not asked for each pair; the pairs are found in the joined rows by searching sorted times."""
    width = before_s + after_s
    bucket = lambda c, shift: F.floor((F.unix_micros(c) + shift * 1_000_000) / (width * 1_000_000))
    o = origins.select("idx", F.unix_micros("ts").alias("us"), F.explode(F.sequence(bucket(F.col("ts"), -before_s), bucket(F.col("ts"), after_s))).alias("b"))
    p = picks.select("pick_id", F.unix_micros("ts").alias("us"), bucket(F.col("ts"), 0).alias("b"))
    o = _packs(o, "idx").toDF("b", "idx", "origin_us", "origin_last").withWatermark("origin_last", late)
    p = _packs(p, "pick_id").toDF("k", "pick_id", "pick_us", "pick_last").withWatermark("pick_last", late)
    # of one bucket, the last times are never further apart; it tells Spark how long to keep them
    near = F.expr(f"b = k AND pick_last >= origin_last - INTERVAL {2 * width} SECONDS AND pick_last <= origin_last + INTERVAL {2 * width} SECONDS")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for idx, at, pick, time in zip(frame["idx"], frame["origin_us"], frame["pick_id"], frame["pick_us"], strict=True):
                low, high = np.searchsorted(time, at - before_s * 1_000_000, "left"), np.searchsorted(time, at + after_s * 1_000_000, "right")
                many = high - low
                part = np.cumsum(many) // PAIRS
                for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                    n = many[some]
                    found = np.arange(n.sum()) + np.repeat(low[some] - np.cumsum(n) + n, n)
                    if len(found):
                        yield pd.DataFrame({"idx": np.repeat(idx[some], n), "origin_us": np.repeat(at[some], n), "pick_id": pick[found], "pick_us": time[found]})

    kinds = [f.schema[c].dataType.simpleString() for f, c in ((origins, "idx"), (picks, "pick_id"))]
    found = o.join(p, near).select("idx", "origin_us", "pick_id", "pick_us").mapInPandas(run, f"idx {kinds[0]}, origin_us long, pick_id {kinds[1]}, pick_us long")
    return found.select("idx", F.timestamp_micros("origin_us").alias("origin_ts"), "pick_id", F.timestamp_micros("pick_us").alias("pick_ts"))


def numbered(events: DataFrame, *, key: str = "day", id: str = "event_id", at: str = "ts") -> DataFrame:
    """Ids within a key in order of arrival, kept in state over batches; what arrives in one batch is in order
    of time and id. A key's rows of a batch come in several frames, so they are gathered (a time and an id
    each) and sorted as one."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        own = pd.concat([f[[at, id]] for f in frames], ignore_index=True).sort_values([at, id])[id].to_numpy()
        state.update((n + len(own),))
        for start in range(0, len(own), GATHERED):
            part = own[start : start + GATHERED]
            yield pd.DataFrame({key: group[0], id: part, "k": range(n + start, n + start + len(part))})

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id)}
    return events.select(key, id, at).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{id}` {kinds[id]}, k long", "n long", "append", "NoTimeout")
