"""Python-backed functions for SQL and DataFrames: a table function and a grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .slopes import median_slope


@F.udtf(returnType=StructType().add("a", StringType()).add("b", StringType()))
class Pairs:
    """Every two different items of an array, the smaller first, as rows."""

    def eval(self, items: list[str]):
        own = sorted(set(items or []))
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                yield a, b


@F.pandas_udf(DoubleType())
def theil_slope(x: pd.Series, y: pd.Series) -> float:
    """Median slope over all pairs of a group with different x; null without any. A group is one task, its work
    n log n (:mod:`slopes`)."""
    return median_slope(x.to_numpy(float), y.to_numpy(float))


#: Points up to which a group's pairs are made of its array.
PAIRED = 200


@F.pandas_udf(DoubleType())
def _slopes(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([median_slope(np.asarray(a, float), np.asarray(b, float)) for a, b in zip(x, y, strict=True)], dtype=float)


def theil_slopes(points: DataFrame, *, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """keys and ``slope`` as of :func:`theil_slope`, of points with x and y, for groups that have one. Groups of up
    to PAIRED points, of which there may be many, need no Python."""
    both = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    own = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.collect_list(both).alias("p"))
    later = lambda a, i: F.filter(F.slice("p", i + 2, F.size("p")), lambda b: b["x"] != a["x"])
    slopes = F.flatten(F.transform("p", lambda a, i: F.transform(later(a, i), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"]))))
    few = own.filter(F.size("p") <= PAIRED).withColumn("s", F.array_sort(slopes)).filter(F.size("s") > 0)
    middle = lambda n: F.col("s")[F.floor(n / 2).cast("int")]
    found = few.select(*keys, ((middle(F.size("s") - 1) + middle(F.size("s"))) / 2).alias("slope"))
    return found.union(own.filter(F.size("p") > PAIRED).select(*keys, _slopes(F.col("p")["x"], F.col("p")["y"]).alias("slope")).filter("NOT isnan(slope)"))


def register(spark: SparkSession) -> None:
    """``item_pairs(array)`` in FROM and ``theil_slope(x, y)`` in aggregates of SQL."""
    spark.udtf.register("item_pairs", Pairs)
    spark.udf.register("theil_slope", theil_slope)
