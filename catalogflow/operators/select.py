"""Exact order statistics of groups of any size, by narrowing histograms: no group's values meet in a task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .written import dropped, written

#: Bins of a round, and values that may be left in a group's bracket when they are sorted.
BINS, FEW = 256, 20_000
#: Rounds after which what is left is sorted whatever its number: with this many bins each takes 8 bits off.
ROUNDS = 12


def percentiles(frame: DataFrame, *, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """keys, ``name`` (the percentile between the two nearest ranks, as ``percentile`` gives it) and ``n`` of
    the non-null values of each group; groups without any are left out.

    Each round is one aggregation over what lies in the groups' brackets: counts, least and largest values of
    BINS bins between a bracket's ends. The bin that holds the rank sought is the next bracket; where the two
    ranks fall into two bins, their ends are the answer. Partial counts are combined before the shuffle, so
    a group of all rows costs no more than many groups. At last brackets of at most FEW values are sorted.
    NaN counts as a value above all others.
    """
    keys = list(keys)
    value_of = F.col(value).cast("double")
    rows = frame.select(*keys, value_of.alias("v")).filter("v IS NOT NULL")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("n") - 1
    held = written(whole.withColumns({"rank": F.floor(place * share).cast("long"), "part": place * share - F.floor(place * share), "left": F.col("n"), "one": F.lit(None).cast("double"), "two": F.lit(None).cast("double")}))
    step = lambda: F.col("left") > F.lit(FEW)
    for _ in range(ROUNDS):
        state = _settled(held)
        open_ = state.filter(F.col("one").isNull() & step())
        if open_.isEmpty():
            break
        met = rows.alias("r").join(open_.alias("s"), same("r", "s")).filter("r.v >= s.low AND r.v <= s.high")
        wide = F.col("s.high") / 2 - F.col("s.low") / 2  # halves, as the difference itself may leave the range
        linear = F.least(F.lit(BINS - 1), F.floor(F.try_divide(F.col("r.v") / 2 - F.col("s.low") / 2, wide) * BINS))
        endless = (F.col("s.low") == -math.inf) | (F.col("s.high") == math.inf)
        ends = F.when(F.col("r.v") == -math.inf, 0).when(F.col("r.v") == math.inf, BINS - 1).otherwise(1)
        bin_ = F.when(F.isnan("s.high"), F.when(F.isnan("r.v"), 1).otherwise(0)).when(endless, ends).otherwise(linear)
        bins = met.select(*(F.col(f"s.{k}").alias(k) for k in keys), "v", bin_.cast("int").alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        w = Window.partitionBy(*keys).orderBy("bin")
        bins = bins.withColumn("before", F.sum("m").over(w) - F.col("m")).withColumn("next", F.lead("a").over(w))
        found = bins.alias("r").join(open_.alias("s"), same("r", "s")).filter("r.before <= s.rank AND s.rank < r.before + r.m")
        last = F.col("s.rank") == F.col("r.before") + F.col("r.m") - 1
        new = {"n": F.col("s.n"), "low": F.col("r.a"), "high": F.col("r.b"), "rank": F.col("s.rank") - F.col("r.before"), "part": F.col("s.part"), "left": F.col("r.m"), "one": F.when(last, F.col("r.b")), "two": F.when(last, F.coalesce("r.next", "r.b"))}
        after = found.select(*(F.col(f"s.{k}").alias(k) for k in keys), *(c.alias(k) for k, c in new.items()))
        before, held = held, written(state.filter(~(F.col("one").isNull() & step())).unionByName(after))
        dropped(before)
    state = _settled(held)
    open_ = state.filter("one IS NULL")
    met = rows.alias("r").join(open_.alias("s"), same("r", "s")).filter("r.v >= s.low AND r.v <= s.high").select(*(F.col(f"s.{k}").alias(k) for k in keys), "n", "part", "rank", "v")
    ordered = met.groupBy(*keys, "n", "part", "rank").agg(F.array_sort(F.collect_list("v")).alias("all"))  # at most FEW
    at = F.col("rank").cast("int") + 1
    sorted_ = ordered.select(*keys, "n", "part", F.element_at("all", at).alias("one"), F.element_at("all", F.least(at + 1, F.size("all"))).alias("two"))
    done = state.filter("one IS NOT NULL").select(*sorted_.columns).unionByName(sorted_)
    between = F.when(F.col("part") == 0, F.col("one")).otherwise(F.col("one") + (F.col("two") - F.col("one")) * F.col("part"))
    return done.select(*keys, between.alias(name), "n")


def _settled(state: DataFrame) -> DataFrame:
    """Brackets of one value are settled: the next rank, if there is one, lies in the same bracket."""
    one = F.col("one").isNull() & (F.col("low") == F.col("high"))
    out = state.withColumn("__one", one)
    return out.withColumn("two", F.when(F.col("__one"), F.col("low")).otherwise(F.col("two"))).withColumn("one", F.when(F.col("__one"), F.col("low")).otherwise(F.col("one"))).drop("__one")
