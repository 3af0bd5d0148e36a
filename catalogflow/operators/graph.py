"""Links between events: components, forests, nearest parents, density clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import grid_pairs
from .parents import nearest_parent
from .written import dropped, written

__all__ = ["connected", "density_clusters", "depths", "families_by_size", "nearest_parent"]


def connected(edges: DataFrame, nodes: DataFrame, *, a: str, b: str, id: str) -> DataFrame:
    """``nodes`` (id) with ``family``: the smallest id that edges reach.

    Each round every label that has a smaller neighbour label hooks to the smallest one, chains of hooks
    are shortened, and edges within one label go. As at least half of the labels with open edges hook,
    rounds go with the logarithm of their number. Tables are written between them, as a checkpoint keeps the plan's
    estimated size, on which a driver would spend longer each round.
    """
    labels = written(nodes.select(F.col(id).alias("u")).distinct().withColumn("label", F.col("u")))
    ends = lambda x, y: [F.least(x, y).alias("low"), F.greatest(x, y).alias("high")]
    open_ = written(edges.select(*ends(F.col(a), F.col(b))).filter("low < high").distinct())
    while not open_.isEmpty():
        hook = written(open_.groupBy("high").agg(F.min("low").alias("to")))
        for _ in range(2):
            far, before = hook.select(F.col("high").alias("__k"), F.col("to").alias("__far")), hook
            hook = written(hook.join(far, F.col("to") == F.col("__k"), "left").select("high", F.coalesce("__far", "to").alias("to")))
            dropped(before)
        low, high = hook.select(F.col("high").alias("low"), F.col("to").alias("__l")), hook.select("high", F.col("to").alias("__h"))
        before = [open_, labels, hook]
        open_ = written(open_.join(low, "low", "left").join(high, "high", "left").select(*ends(F.coalesce("__l", "low"), F.coalesce("__h", "high"))).filter("low < high").distinct())
        labels = written(labels.join(hook.withColumnRenamed("high", "label"), "label", "left").select("u", F.coalesce("to", "label").alias("label")))
        dropped(*before)
    dropped(open_)
    return labels.select(F.col("u").alias(id), F.col("label").alias("family"))


def depths(forest: DataFrame, *, id: str, parent: str) -> DataFrame:
    """``root`` and ``depth`` of each node of a forest (parent null at roots), by doubling pointers."""
    state = forest.select(F.col(id).alias("id"), F.coalesce(F.col(parent), F.col(id)).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    state = written(state)
    while True:
        over = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        after = state.join(over, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.when(F.col("up") == F.col("id"), 0).otherwise(F.col("d2"))).alias("depth"), (F.col("up2") != F.col("up")).alias("moved"))
        after = written(after)
        dropped(state)
        if after.filter("moved").isEmpty():
            return after.select(F.col("id").alias(id), F.col("up").alias("root"), "depth")
        state = after


def families_by_size(labels: DataFrame, *, id: str, family: str = "family") -> DataFrame:
    """``rank``: 1 for the largest family, ties by label; ``n``: its size."""
    sizes = labels.groupBy(family).agg(F.count("*").alias("n"))
    return labels.join(sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), family))), family)


def density_clusters(points: DataFrame, *, id: str, coords: Sequence[str], reach: float, least: int) -> DataFrame:
    """DBSCAN: id and cluster (smallest core id of its component; null for noise).

    Core points have ``least`` points within reach, themselves included. A border point goes to the core
    point nearest to it (ties: smaller id). Points of one place are one, told by its smallest id and counted.
    """
    there = points.select(id, *(F.col(c).cast("double").alias(c) for c in coords))
    places = there.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in coords)).groupBy(*coords).agg(F.min(id).alias("p"), F.count("*").alias("n")).checkpoint()
    sizes = places.select(F.col("p").alias("b"), "n")
    pairs = grid_pairs(places.select("p", *coords), id="p", coords=coords, reach=reach).select(F.col("p_a").alias("a"), F.col("p_b").alias("b"), "apart").checkpoint()
    both = pairs.union(pairs.select("b", "a", "apart"))
    counted = both.join(sizes, "b").select("a", "n").union(places.select("p", "n"))
    core = counted.groupBy(F.col("a").alias("core")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("core").checkpoint()
    links = pairs.join(core.withColumnRenamed("core", "a"), "a", "left_semi").join(core.withColumnRenamed("core", "b"), "b", "left_semi")
    found = connected(links, core, a="a", b="b", id="core")
    border = both.join(core, F.col("b") == F.col("core"), "left_semi").join(core, F.col("a") == F.col("core"), "left_anti").groupBy(F.col("a").alias("p")).agg(F.min(F.struct("apart", "b")).alias("s")).select("p", F.col("s.b").alias("core"))
    placed = found.select(F.col("core").alias("p"), "family").union(border.join(found, "core").select("p", "family"))
    told = places.join(placed, "p").select(*coords, F.col("family").alias("cluster"))
    return there.join(told, list(coords), "left").select(id, "cluster")
