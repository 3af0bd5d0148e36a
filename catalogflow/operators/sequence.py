"""Order-bound operators: one-to-one alignment, nudging of equal times. One ordered group a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import DAY_US
from . import joins as jn
from . import windows as wn


#: Runs of times near one another that one task walks through.
RUNS = 500


def best_offset(left: DataFrame, right: DataFrame, *, at: str, time: str, offsets: Sequence[int], reach: int) -> int:
    """The offset to add to ``at`` that brings the left times nearest to the right ones: the smallest
    median gap; rows without a right time within ``reach`` count as that far."""
    found = []
    for k, offset in enumerate(offsets):
        moved = left.select((F.col(at) + offset).alias("__at")).withColumn("__id", F.monotonically_increasing_id())
        near = jn.nearest_left(moved, right.select(F.col(time).alias("__time"), F.lit(0).alias("__rid")), at="__at", time="__time", tolerance=reach, left_id="__id", right_id="__rid")
        found.append((near.agg(F.median(F.coalesce(F.abs("dt"), F.lit(reach)))).first()[0], k, offset))
    return min(found)[2]


def aligned(left: DataFrame, right: DataFrame, *, keys: Sequence[str], left_id: str, at: str, right_id: str, time: str, tolerance: int) -> DataFrame:
    """One-to-one pairs in time order: both lists are walked once; a pair within the tolerance is taken,
    else the earlier side moves on.

    A gap of more than the tolerance in the times of both lists together parts the walk: no pair spans it.
    So each key's rows are cut there into runs (by days and carried counts), and RUNS of them are one group.
    """
    a = left.select(*keys, F.col(left_id).alias("id"), F.col(at).alias("t"), F.lit(0).alias("side"))
    b = right.select(*keys, F.col(right_id).alias("id"), F.col(time).alias("t"), F.lit(1).alias("side"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["t", "id"])
        x, y = (frame[frame["side"] == s][["t", "id"]].to_numpy(np.int64) for s in (0, 1))
        i = j = 0
        out = []
        while i < len(x) and j < len(y):
            if abs(x[i, 0] - y[j, 0]) <= tolerance:
                out.append((x[i, 1], y[j, 1]))
                i, j = i + 1, j + 1
            elif x[i, 0] < y[j, 0]:
                i += 1
            else:
                j += 1
        pairs = pd.DataFrame(out, columns=["left_id", "right_id"]).astype("int64")
        for k in keys:
            pairs[k] = frame[k].iloc[0]
        return pairs[[*keys, "left_id", "right_id"]]

    fields = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    both = a.union(b).withColumn("o", F.col("id") * 2 + F.col("side"))
    both = wn.previous(both, keys=keys, at="t", id="o", width=max(tolerance, DAY_US), value="t", name="__t")
    opens = F.when(F.col("t") - F.col("__t") <= tolerance, 0).otherwise(1)
    both = wn.carried(both, keys=keys, at="t", id="o", width=max(tolerance, DAY_US), sums={"__run": opens}).drop("__run_all", "__t", "o")
    return both.withColumn("__runs", F.floor(F.col("__run") / RUNS)).groupBy(*keys, "__runs").applyInPandas(run, f"{fields}, left_id long, right_id long")


def nudged(rows: DataFrame, *, keys: Sequence[str], id: str, at: str, step: int, width: int) -> DataFrame:
    """``moved``: times made strictly increasing, each at least ``step`` after the one before it.

    moved_i = max over j <= i of (t_j + (i - j) * step), a running maximum of t_j - j * step. It runs
    within buckets of ``width``, from the number of rows and the maximum that the buckets before carry.
    """
    numbered = wn.carried(rows, keys=keys, at=at, id=id, width=width, sums={"__i": F.lit(1).cast("long")}).drop("__i_all")
    own = numbered.withColumn("__lead", F.col(at) - F.col("__i") * step).withColumn("__b", F.floor(F.col(at) / width))
    tops = own.groupBy(*keys, "__b").agg(F.max("__lead").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "__b", F.max("__top").over(before).alias("__carried"))
    within = Window.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumn("__top", F.max("__lead").over(within)).join(tops, [*keys, "__b"])
    return run.withColumn("moved", F.greatest("__top", "__carried") + F.col("__i") * step).drop("__b", "__i", "__lead", "__top", "__carried")
