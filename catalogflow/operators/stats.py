"""Estimators over catalogs: sizes, rates, periodicity, geometry, fits. All are aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import windows as wn

LN10 = math.log(10)


def tenths(magnitude: Column, width: int = 1) -> Column:
    """Bin of a magnitude as a whole number of tenths (half-even), ``width`` tenths wide."""
    return (F.floor(F.bround(magnitude * 10) / width) * width).cast("int")


def size_distribution(events: DataFrame, *, magnitude: str, keys: Sequence[str] = ()) -> DataFrame:
    """m10 (tenths), n, and n_cum: how many are at least as large."""
    counts = events.groupBy(*keys, tenths(F.col(magnitude)).alias("m10")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m10")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("n_cum", F.sum("n").over(w))


def completeness(events: DataFrame, *, magnitude: str, keys: Sequence[str] = (), shift: float = 0.2) -> DataFrame:
    """mc: the fullest bin (the smallest if several) plus ``shift``."""
    counts = events.groupBy(*keys, tenths(F.col(magnitude)).alias("m10")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("m10")).alias("k"))).alias("best")).select(*keys, F.round(-F.col("best.k") / 10 + shift, 6).alias("mc"))


def b_value(magnitude: Column, mc: Column, width: float = 0.1) -> Column:
    """Aki-Utsu, as an aggregate over magnitudes that are at least mc."""
    return 1 / (LN10 * (F.avg(magnitude) - (F.first(mc) if isinstance(mc, Column) else F.lit(mc)) + width / 2))


def b_positive(events: DataFrame, *, magnitude: str, at: str, id: str, width: int, keys: Sequence[str] = (), least: float = 0.1) -> DataFrame:
    """b from the positive differences of successive magnitudes, which run in buckets of ``width``."""
    own = wn.previous(events, keys=keys, at=at, id=id, width=width, value=magnitude, name="__before")
    d = own.withColumn("d", F.round(F.col(magnitude) - F.col("__before"), 6)).filter(F.col("d") >= least)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), (1 / (LN10 * (F.avg("d") - least + 0.05))).alias("b"))


def circular(phase: Column) -> list[Column]:
    """n, resultant, p (exp(-R^2 / n)) and peak phase of angles in radians."""
    c, s = F.sum(F.cos(phase)), F.sum(F.sin(phase))
    n = F.count(phase)
    return [n.alias("n"), F.sqrt(c * c + s * s).alias("resultant"), F.exp(-(c * c + s * s) / n).alias("p"), F.pmod(F.atan2(s, c) + 2 * math.pi, F.lit(2 * math.pi)).alias("peak")]


def benjamini_hochberg(tests: DataFrame, *, p: str, id: str) -> DataFrame:
    """``q``: p * m / rank, made monotone from the largest p down."""
    rank = F.row_number().over(Window.orderBy(p, id))
    scaled = tests.withColumn("rank", rank).withColumn("raw", F.col(p) * F.count("*").over(Window.partitionBy()) / F.col("rank"))
    return scaled.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)))).drop("raw")


def total_least_squares_slope(x: Column, y: Column) -> Column:
    """Closed form from the second moments."""
    sxx, syy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return (syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy)


def azimuthal_gap(rows: DataFrame, *, keys: Sequence[str], azimuth: str) -> DataFrame:
    """The largest angle between neighbouring azimuths round the circle; 360 under two."""
    w = Window.partitionBy(*keys).orderBy(azimuth)
    first = F.min(azimuth).over(Window.partitionBy(*keys))
    step = F.coalesce(F.lead(azimuth).over(w), first + 360) - F.col(azimuth)
    return rows.select(*keys, azimuth, step.alias("step")).groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") < 2, 360.0).otherwise(F.max("step")).alias("gap"))


def burst_share(rows: DataFrame, *, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Largest share of a group's rows that one window [t - width, t] holds; null under two rows."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-width, 0)
    return rows.withColumn("__in", F.count("*").over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.max("__in") / F.count("*")).alias("burst"))


def interval_variation(rows: DataFrame, *, keys: Sequence[str], at: str) -> DataFrame:
    """Population deviation over mean of the positive times between successive rows."""
    dt = F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("dt", dt.cast("double")).filter("dt > 0").groupBy(*keys).agg(F.count("*").alias("n"), (F.stddev_pop("dt") / F.avg("dt")).alias("cov"))


def box_counts(points: DataFrame, *, coords: Sequence[str], sizes: Sequence[float]) -> DataFrame:
    """size, box and n: how many points each box of each size holds. Boxes start at the smallest
    coordinate; the counts of all sizes come from one pass."""
    lows = points.agg(*(F.min(c).alias(f"lo_{c}") for c in coords)).first()
    at = points.withColumn("size", F.explode(F.array(*(F.lit(float(s)) for s in sizes))))
    boxes = [F.floor((F.col(c) - lows[f"lo_{c}"]) / F.col("size")).alias(f"box_{c}") for c in coords]
    return at.groupBy("size", *boxes).agg(F.count("*").alias("n"))


def renyi_slopes(boxes: DataFrame, orders: Sequence[int]) -> DataFrame:
    """Dimension of each order from box counts: slopes of log sums of p^q over log size."""
    total = F.sum("n").over(Window.partitionBy("size"))
    shares = boxes.withColumn("p", F.col("n") / total).withColumn("q", F.explode(F.array(*map(F.lit, orders))))
    level = shares.groupBy("q", "size").agg(F.when(F.first("q") == 1, F.sum(F.col("p") * F.log("p"))).otherwise(F.log(F.sum(F.pow("p", "q")))).alias("y"))
    slope = F.expr("regr_slope(y, ln(size))")
    return level.groupBy("q").agg(F.when(F.first("q") == 1, slope).otherwise(slope / (F.first("q") - 1)).alias("dimension"))


def spread(rows: DataFrame, *, keys: Sequence[str], x: str, y: str, z: str) -> DataFrame:
    """Root mean square distance from the centroid in the plane, sample deviation of depth."""
    c = rows.groupBy(*keys).agg(F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    return rows.join(c, list(keys)).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col(x) - F.col("__x"), 2) + F.pow(F.col(y) - F.col("__y"), 2))).alias("rms"), F.stddev_samp(z).alias("depth_std"), F.count("*").alias("n"))


def family_class(events: DataFrame, *, keys: Sequence[str], magnitude: str, at: str, id: str) -> DataFrame:
    """n, log_moment, share (of the moment, by the largest event), before and after (shares of the events
    before and after it) and kind of each family: swarm below a share of 0.4, foreshock_mainshock_aftershock
    or mainshock_aftershock from 0.6 on (with 0.15 of the events before it or not), else mixed."""
    moment = F.pow(F.lit(10.0), 1.5 * F.col(magnitude) + 9.1)
    main = events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(moment).alias("__m"), F.max(moment).alias("__top"), F.max(F.struct(F.col(magnitude).alias("m"), (-F.col(id)).alias("i"), F.col(at).alias("t"))).alias("__s"))
    main = main.withColumn("__t", F.col("__s.t")).drop("__s")
    share = F.first("__top") / F.first("__m")
    before, after = F.avg(F.when(F.col(at) < F.col("__t"), 1.0).otherwise(0.0)), F.avg(F.when(F.col(at) > F.col("__t"), 1.0).otherwise(0.0))
    found = events.join(main, list(keys)).groupBy(*keys, "n").agg(F.log10(F.first("__m")).alias("log_moment"), share.alias("share"), before.alias("before"), after.alias("after"))
    kind = F.when(F.col("share") < 0.4, "swarm").when(F.col("share") < 0.6, "mixed").when(F.col("before") >= 0.15, "foreshock_mainshock_aftershock").otherwise("mainshock_aftershock")
    return found.withColumn("kind", kind)


def omori(events: DataFrame, *, keys: Sequence[str], magnitude: str, days: str, id: str, bins: int = 7, least: int = 8) -> DataFrame:
    """n (events after the largest one) and p of each family: minus the slope of the log10 rate over the
    log10 middle of ``bins`` bins, equal in log10 from the first to the last time after the largest event (0.001
    days at least). Null under ``least`` events or three bins with any."""
    main = events.groupBy(*keys).agg(F.max(F.struct(F.col(magnitude).alias("m"), (-F.col(id)).alias("i"), F.col(days).alias("t"))).alias("s")).select(*keys, F.col("s.t").alias("__t"))
    later = events.join(main, list(keys)).withColumn("__late", F.col(days) - F.col("__t")).filter("__late > 0")
    span = later.groupBy(*keys).agg(F.count("*").alias("n"), F.log10(F.greatest(F.min("__late"), F.lit(1e-3))).alias("__lo"), F.log10(F.max("__late")).alias("__hi"))
    span = span.withColumn("__w", (F.col("__hi") - F.col("__lo")) / bins).filter((F.col("n") >= least) & (F.col("__w") > 0))
    bin_ = F.least(F.floor((F.log10("__late") - F.col("__lo")) / F.col("__w") + 1e-12), F.lit(bins - 1))
    counts = later.select(*keys, "__late").join(span, list(keys)).withColumn("__bin", bin_).filter("__bin >= 0").groupBy(*keys, "n", "__lo", "__w", "__bin").agg(F.count("*").alias("__c"))
    edge = lambda shift: F.pow(F.lit(10.0), F.col("__lo") + (F.col("__bin") + shift) * F.col("__w"))
    rated = counts.withColumn("__y", F.log10(F.col("__c") / (edge(1) - edge(0)))).withColumn("__x", F.col("__lo") + (F.col("__bin") + 0.5) * F.col("__w"))
    return rated.groupBy(*keys, "n").agg(F.when(F.count("*") >= 3, -F.regr_slope("__y", "__x")).alias("p"))
