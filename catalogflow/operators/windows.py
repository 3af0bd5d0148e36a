"""Windows: dedup and ambiguity rules, ids, epochs, rolling and hopping estimators, islands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

def resolve_ambiguous(candidates: DataFrame, *, pick: Sequence[str], residual: str, event: str, tie: float) -> tuple[DataFrame, DataFrame]:
    """Accepted candidates and decisions for picks that fit more than one event.

    A pick goes to the event with the smallest absolute residual; if the next one is less than ``tie``
    behind, it goes to none. Always two relations, also for no input.
    """
    order = Window.partitionBy(*pick).orderBy(F.abs(residual), event)
    two = candidates.withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    ranked = two.withColumn("runner_event", F.lead(event).over(order)).withColumn("runner_residual", F.lead(residual).over(order))
    best = ranked.filter("rank = 1").withColumn("gap", F.abs("runner_residual") - F.abs(residual))
    clear = best.filter(F.col("gap").isNull() | (F.col("gap") >= tie)).select(*candidates.columns)
    decided = best.filter("gap IS NOT NULL").select(*pick, F.col(event).alias("best_event"), F.col(residual).alias("best_residual"), "runner_event", "runner_residual", F.when(F.col("gap") < tie, "dropped_ambiguous").otherwise("best_match_wins").alias("decision"))
    return clear, decided


def first_by(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return frame.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def same_second_ids(events: DataFrame, *, at: str, id: str, stamp: Column) -> DataFrame:
    """``event_key``: the second's stamp; the second event in it gets b, the third c, ..."""
    k = F.row_number().over(Window.partitionBy(stamp).orderBy(at, id)) - 1
    return events.withColumn("event_key", F.concat(stamp, F.when(k == 0, "").otherwise(text.character(97 + k))))


def with_epochs(rows: DataFrame, *, key: str, start: str, end: str) -> DataFrame:
    """Half-open epochs of a key: each ends where the next starts; codes get a letter if there is more
    than one."""
    w = Window.partitionBy(key).orderBy(start)
    many = F.count("*").over(Window.partitionBy(key)) > 1
    letter = F.when(many, text.character(96 + F.row_number().over(w))).otherwise("")
    return rows.withColumn("epoch_code", F.concat(F.col(key), letter)).withColumn("t1", F.coalesce(F.lead(start).over(w), F.col(end)))


#: Rows of the groups that one frame gathers, about.
DEALT = 100_000


class RankTree:
    """Values in order of time, by their ranks' bits, from the highest on: on each level those of bit 0 come
    before those of bit 1, in order of time, and counts say how many of bit 0 stand before a place."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted = np.sort(values)
        now = np.empty(len(values), np.int64)
        now[np.argsort(values, kind="stable")] = np.arange(len(values))
        self.bits = max(1, int(max(len(values) - 1, 1)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (now >> bit) & 1 == 0
            before = np.append(0, np.cumsum(zero))
            self.levels.append(before)
            now = np.concatenate([now[zero], now[~zero]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values at places low to high - 1, for all queries at once."""
        low, high, k, rank = low.copy(), high.copy(), k.copy(), np.zeros(len(k), np.int64)
        for before in self.levels:
            a, b = before[low], before[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
            rank = rank * 2 + one
        return self.sorted[rank]


def rolling_percentiles(frame: DataFrame, *, keys: Sequence[str], at: str, value: str, width: int, shares: Sequence[float], least: int, names: Sequence[str]) -> DataFrame:
    """Exact percentiles over (at - width, at] of the same keys; null under ``least`` values.

    Time is cut into buckets of the width, and a row goes to its own bucket and the next, so a group is two
    widths of one key and a hot key spreads over time. Groups are gathered by hash, about DEALT rows of them
    in a frame; all windows of a frame ask one :class:`RankTree` over its groups, one after the other, level
    by level.
    """
    own = frame.withColumn("__b", F.floor(F.col(at) / width))
    many = max(1, 2 * frame.count() // DEALT)
    group = [*keys, "__to"]
    dealt = own.withColumn("__to", F.explode(F.array(F.col("__b"), F.col("__b") + 1))).withColumn("__deal", F.pmod(F.xxhash64(*group), F.lit(many)))
    kinds = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows[at].to_numpy(np.int64), rows.groupby(group, sort=False, dropna=False).ngroup().to_numpy()))]
        number = rows.groupby(group, sort=False, dropna=False).ngroup().to_numpy()
        mine, sound, t = (rows["__b"] == rows["__to"]).to_numpy(), rows[value].notna().to_numpy(), rows[at].to_numpy(np.int64)
        place, low, high = np.append(0, np.cumsum(sound)), np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        edges = np.flatnonzero(np.append(True, number[1:] != number[:-1])).tolist()
        for lo, hi in zip(edges, [*edges[1:], len(t)], strict=True):
            low[lo:hi], high[lo:hi] = (lo + np.searchsorted(t[lo:hi], x, "right") for x in (t[lo:hi] - width, t[lo:hi]))
        low, high = place[low[mine]], place[high[mine]]
        enough = high - low >= max(1, least)
        out = np.full((len(shares), len(low)), np.nan)
        if enough.any():
            tree, low, high = RankTree(rows[value].to_numpy(float)[sound]), low[enough], high[enough]
            for k, share in enumerate(shares):
                at_rank = share * (high - low - 1)
                first = at_rank.astype(np.int64)
                one, two = tree.kth(low, high, first), tree.kth(low, high, np.minimum(first + 1, high - low - 1))
                out[k, enough] = one + (two - one) * (at_rank - first)
        return rows[[n for n, _ in kinds]][mine].assign(**dict(zip(names, out, strict=True)))

    fields = ", ".join(f"`{n}` {kind}" for n, kind in [*kinds, *((n, "double") for n in names)])
    found = dealt.groupBy("__deal").applyInPandas(run, fields)
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def carried(frame: DataFrame, *, keys: Sequence[str], at: str, id: str, width: int, sums: Mapping[str, Column]) -> DataFrame:
    """``frame`` with, for each name of ``sums``, the running sum by (at, id) of its column over equal keys,
    and ``<name>_all``, the sum of all.

    Few keys would be few tasks. So rows run within buckets of ``width``, and each bucket starts from what
    those before it add up to, a window over one row a bucket.
    """
    own = frame.withColumn("__b", F.floor(F.col(at) / width)).withColumns({f"__{n}": c for n, c in sums.items()})
    totals = own.groupBy(*keys, "__b").agg(*(F.sum(f"__{n}").alias(f"__{n}_in") for n in sums))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "__b", *(F.coalesce(F.sum(f"__{n}_in").over(before), F.lit(0)).alias(f"__{n}_0") for n in sums), *(F.sum(f"__{n}_in").over(Window.partitionBy(*keys)).alias(f"{n}_all") for n in sums))
    within = Window.partitionBy(*keys, "__b").orderBy(at, id).rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({n: F.sum(f"__{n}").over(within) for n in sums}).join(starts, [*keys, "__b"])
    return run.withColumns({n: F.col(n) + F.col(f"__{n}_0") for n in sums}).drop("__b", *(f"__{n}{x}" for n in sums for x in ("", "_0")))


def previous(frame: DataFrame, *, keys: Sequence[str], at: str, id: str, width: int, value: str, name: str) -> DataFrame:
    """``frame`` with ``name``: ``value`` of the row before, by (at, id), of equal keys; by buckets as in
    :func:`carried`: the first row of a bucket takes the last row of the buckets before."""
    own = frame.withColumn("__b", F.floor(F.col(at) / width))
    lasts = own.groupBy(*keys, "__b").agg(F.max(F.struct(F.col(at).alias("at"), F.col(id).alias("id"), F.col(value).alias("value"))).alias("__s"))
    before = lasts.select(*keys, "__b", F.lag("__s.value").over(Window.partitionBy(*keys).orderBy("__b")).alias("__v"))
    within = Window.partitionBy(*keys, "__b").orderBy(at, id)
    run = own.withColumn("__k", F.row_number().over(within)).withColumn(name, F.lag(value).over(within)).join(before, [*keys, "__b"])
    return run.withColumn(name, F.when(F.col("__k") == 1, F.col("__v")).otherwise(F.col(name))).drop("__b", "__k", "__v")


def centred_median(frame: DataFrame, *, keys: Sequence[str], order: Sequence[str], value: str, before: int, after: int, least: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return frame.withColumn(name, F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w)))


def hopping(frame: DataFrame, *, at: str, first: float, last: float, step: float, half: float) -> DataFrame:
    """``frame`` with ``centre``: each row in every window [centre - half, centre + half) of the grid.

    Rows are dealt to their windows by arithmetic, so no join with the grid is needed.
    """
    k0 = F.floor((F.col(at) - half - first) / step).cast("int") + 1
    k1 = F.floor((F.col(at) + half - first) / step).cast("int")
    most = round((last - first) / step)
    k = F.explode(F.filter(F.sequence(k0 - 1, k1 + 1), lambda k: (k >= 0) & (k <= most) & (F.col(at) >= first + k * step - half) & (F.col(at) < first + k * step + half)))
    return frame.withColumn("__k", k).withColumn("centre", F.round(first + F.col("__k") * step, 6)).drop("__k")


def islands(days: DataFrame, *, keys: Sequence[str], day: str, gap: int = 1) -> DataFrame:
    """Runs of days (integers) not more than ``gap`` apart: first, last, n."""
    w = Window.partitionBy(*keys).orderBy(day)
    flagged = days.withColumn("__new", F.when(F.col(day) - F.lag(day).over(w) <= gap, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return flagged.groupBy(*keys, "__run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("__run")


def epoch_ordinal(breaks: Column, day: Column) -> Column:
    """How many breaks of a sorted array are not after the day."""
    return F.coalesce(F.size(F.filter(breaks, lambda b: b <= day)), F.lit(0))


def merge_small(frame: DataFrame, *, unit: str, parent: str, least: int, protect: str | None = None) -> DataFrame:
    """``unit`` falls back to its parent where it has fewer than ``least`` rows, unless protected."""
    n = F.count("*").over(Window.partitionBy(unit))
    stay = n >= least if protect is None else (n >= least) | (F.col(unit) == protect)
    return frame.withColumn("unit_merged", F.when(stay, F.col(unit)).otherwise(F.col(parent)))


def global_index(frame: DataFrame, *, group: str, local: str) -> DataFrame:
    """Ids over all groups: each group's start after the previous groups' largest ids."""
    tops = frame.groupBy(group).agg((F.max(local) + 1).alias("__top"))
    w = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.withColumn("__start", F.coalesce(F.sum("__top").over(w), F.lit(0))).drop("__top")
    return frame.join(starts, group).withColumn("global_id", F.col("__start") + F.col(local)).drop("__start")


def changes(frame: DataFrame, *, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """``previous``: the last non-null value before; rows without one have null."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumn("previous", F.last(value, ignorenulls=True).over(w))
