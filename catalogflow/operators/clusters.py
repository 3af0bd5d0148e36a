"""Clusters by Spark's estimators, and indices of given labels as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written


def _features(points: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="__v", handleInvalid="skip").transform(points)


def kmeans(points: DataFrame, *, id: str, features: Sequence[str], k: int, seed: int = 0, starts: int = 1) -> DataFrame:
    """id and cluster of k-means on standardised features; of ``starts`` runs the one of the least cost."""
    model, scaled = _best(points, features, k, seed, starts)
    return model.transform(scaled).select(id, "cluster")


def _best(points: DataFrame, features: Sequence[str], k: int, seed: int, starts: int):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler

    own = _features(points, features)
    scaled = StandardScaler(withMean=True, inputCol="__v", outputCol="__s").fit(own).transform(own)
    models = [KMeans(k=k, seed=seed + i, featuresCol="__s", predictionCol="cluster").fit(scaled) for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost), scaled


def cost_curve(points: DataFrame, *, features: Sequence[str], ks: Sequence[int], seed: int = 0, starts: int = 1, nulls: int = 0) -> DataFrame:
    """k, cost (within-cluster sum of squares of standardised features), knee (the k furthest under the line
    from the first cost to the last) and, with ``nulls`` uniform tables over the same ranges, gap (mean log
    cost of theirs less the log cost) and gap_s (its deviation)."""
    own = points.select(*features).dropna()
    costs = [_best(own, features, k, seed, starts)[0].summary.trainingCost for k in ks]
    gaps: list[tuple[float | None, float | None]] = [(None, None)] * len(ks)
    if nulls:
        lows = own.agg(*(F.min(f) for f in features)).first()
        highs = own.agg(*(F.max(f) for f in features)).first()
        logs = []
        for i in range(nulls):
            null = own.select(*(F.lit(lo) + F.rand(seed * 1000 + i * 10 + j) * (hi - lo) for j, (lo, hi) in enumerate(zip(lows, highs, strict=True)))).toDF(*features).checkpoint()
            logs.append([math.log(_best(null, features, k, seed, 1)[0].summary.trainingCost) for k in ks])
        for j, cost in enumerate(costs):
            own_logs = [row[j] for row in logs]
            mean = sum(own_logs) / nulls
            spread = math.sqrt(sum((x - mean) ** 2 for x in own_logs) / nulls) * math.sqrt(1 + 1 / nulls)
            gaps[j] = (mean - math.log(cost), spread)
    x = [(k - ks[0]) / max(1, ks[-1] - ks[0]) for k in ks]
    span = costs[0] - costs[-1]
    under = [(1 - a) - (c - costs[-1]) / span if span else 0.0 for a, c in zip(x, costs, strict=True)]
    knee = ks[max(range(len(ks)), key=lambda i: under[i])]
    return points.sparkSession.createDataFrame([(k, c, k == knee, *g) for k, c, g in zip(ks, costs, gaps, strict=True)], "k int, cost double, knee boolean, gap double, gap_s double")


def mixture_bic(points: DataFrame, *, features: Sequence[str], ks: Sequence[int], seed: int = 0) -> DataFrame:
    """k, log_likelihood and bic of normal mixtures with full covariances."""
    from pyspark.ml.clustering import GaussianMixture

    own = _features(points, features).select("__v").checkpoint()
    n, d = own.count(), len(features)
    rows = []
    for k in ks:
        if k == 1:  # one normal: its likelihood follows from the covariance
            pairs = points.dropna(subset=list(features)).agg(*(F.covar_pop(a, b) for a in features for b in features)).first()
            found = -n / 2 * (d * math.log(2 * math.pi) + math.log(np.linalg.det(np.array(pairs, float).reshape(d, d))) + d)
        else:
            found = GaussianMixture(k=k, seed=seed, featuresCol="__v").fit(own).summary.logLikelihood
        rows.append((k, float(found), float(math.log(n) * (k * (1 + d + d * (d + 1) // 2) - 1) - 2 * found)))
    return points.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")


def davies_bouldin(points: DataFrame, *, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / distance with another; scatter is the mean
    distance to the centre. Centres are a row a cluster."""
    centres = points.groupBy(cluster).agg(*(F.avg(f).alias(f"__{f}") for f in features))
    apart = F.sqrt(sum((F.pow(F.col(f) - F.col(f"__{f}"), 2) for f in features), F.lit(0.0)))
    scatter = points.join(centres, cluster).groupBy(cluster, *(f"__{f}" for f in features)).agg(F.avg(apart).alias("s"))
    a, b = (scatter.select(*(F.col(c).alias(f"{c}_{x}") for c in scatter.columns)) for x in "ab")
    between = F.sqrt(sum((F.pow(F.col(f"__{f}_a") - F.col(f"__{f}_b"), 2) for f in features), F.lit(0.0)))
    worst = a.join(b, F.col(f"{cluster}_a") != F.col(f"{cluster}_b")).groupBy(f"{cluster}_a").agg(F.max((F.col("s_a") + F.col("s_b")) / between).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def silhouette(points: DataFrame, *, cluster: str, features: Sequence[str]) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol="__v", predictionCol=cluster).evaluate(_features(points, features))


def calinski_harabasz(points: DataFrame, *, cluster: str, features: Sequence[str]) -> DataFrame:
    """Between over within dispersion, from sums by cluster."""
    sums = points.groupBy(cluster).agg(F.count("*").alias("n"), *(F.sum(f).alias(f"s_{f}") for f in features), *(F.sum(F.col(f) * F.col(f)).alias(f"q_{f}") for f in features))
    total = sums.agg(F.sum("n").alias("N"), F.count("*").alias("k"), *(F.sum(f"s_{f}").alias(f"S_{f}") for f in features), *(F.sum(f"q_{f}").alias(f"Q_{f}") for f in features), *(F.sum(F.col(f"s_{f}") * F.col(f"s_{f}") / F.col("n")).alias(f"B_{f}") for f in features))
    between = sum(F.col(f"B_{f}") - F.col(f"S_{f}") * F.col(f"S_{f}") / F.col("N") for f in features)
    within = sum(F.col(f"Q_{f}") - F.col(f"B_{f}") for f in features)
    return total.select(((between / (F.col("k") - 1)) / (within / (F.col("N") - F.col("k")))).alias("calinski_harabasz"))


def adjusted_rand(labels: DataFrame, *, a: str, b: str) -> DataFrame:
    """Agreement of two labelings, corrected for chance, from the counts of their cells."""
    two = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda f: f.agg(F.sum(two("n")).alias("p"), F.sum("n").alias("n")).first()
    both, rows, cols = pairs(cells), pairs(cells.groupBy(a).agg(F.sum("n").alias("n"))), pairs(cells.groupBy(b).agg(F.sum("n").alias("n")))
    every = both.n * (both.n - 1) / 2
    chance = rows.p * cols.p / every
    top = (rows.p + cols.p) / 2
    return labels.sparkSession.createDataFrame([(1.0 if top == chance else (both.p - chance) / (top - chance),)], "adjusted_rand double")


#: Values that choose the start of a fit of two modes: bins of equal width, a row each.
SUMMARY = 4_096
#: Rounds of a start on the bins.
START_ROUNDS = 2_000
#: So that a mode of one value has a density.
LEAST_VARIANCE = 1e-12


def _fitted_modes(values: DataFrame, modes: list[tuple[float, float, float]], rounds: int, tolerance: float) -> tuple[float, list[tuple[float, float, float]]]:
    """The log likelihood and the modes (mean, variance, weight) of values (x, n) that expectation and maximisation
    come to from ``modes``: a round is one aggregation. The last one gains less than ``tolerance``."""
    before = None
    for done in range(rounds + 1):
        logs = [F.lit(math.log(w) - 0.5 * math.log(2 * math.pi * v)) - (F.col("x") - m) * (F.col("x") - m) / (2 * v) for m, v, w in modes]
        top = F.greatest(*logs)
        rows = values.withColumn("top", top).withColumns({f"d{k}": F.exp(one - top) for k, one in enumerate(logs)}).withColumn("all", F.col("d0") + F.col("d1"))
        shares = [F.col("n") * F.col(f"d{k}") / F.col("all") for k in range(2)]
        off = [F.col("x") - m for m, _, _ in modes]  # moments round the old means, so that nothing cancels
        got = rows.agg(F.sum(F.col("n") * (F.col("top") + F.log("all"))), *(F.sum(e) for s, o in zip(shares, off, strict=True) for e in (s, s * o, s * o * o))).first()
        likely, sums = got[0], (got[1:4], got[4:7])
        if done == rounds or (before is not None and abs(likely - before) < tolerance) or min(s[0] for s in sums) <= 0:
            break
        before, total = likely, sums[0][0] + sums[1][0]
        modes = [(m + b / n, max(c / n - (b / n) ** 2, LEAST_VARIANCE), n / total) for (m, _, _), (n, b, c) in zip(modes, sums, strict=True)]
    return likely, modes


def _started_modes(x: np.ndarray, n: np.ndarray, seed: int, rounds: int, tolerance: float) -> tuple[float, list[tuple[float, float, float]]]:
    """:func:`_fitted_modes` of a few weighted values, from the means and variances of two draws of 15 of them."""
    drawn = x[np.random.default_rng(seed).choice(len(x), (2, 15), p=n / n.sum())]
    m, v, w = drawn.mean(axis=1)[:, None], np.maximum(drawn.var(axis=1), LEAST_VARIANCE)[:, None], np.full((2, 1), 0.5)
    before = -math.inf
    for _ in range(rounds):
        logs = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x - m) ** 2 / (2 * v)
        both = np.logaddexp(*logs)
        likely = float((n * both).sum())
        shares = n * np.exp(logs - both)
        sums = shares.sum(axis=1, keepdims=True)
        if abs(likely - before) < tolerance or sums.min() <= 0:
            break
        before, w = likely, sums / n.sum()
        m = (shares * x).sum(axis=1, keepdims=True) / sums
        v = np.maximum((shares * (x - m) ** 2).sum(axis=1, keepdims=True) / sums, LEAST_VARIANCE)
    return likely, list(zip(m[:, 0].tolist(), v[:, 0].tolist(), w[:, 0].tolist(), strict=True))


def valley(values: DataFrame, *, value: str, seed: int = 0, starts: int = 5) -> DataFrame:
    """Two normal modes of a value and the point between their means where their densities cross.

    Equal values are one row with a count. The likeliest of ``starts`` fits is sought on the means of at most
    SUMMARY bins; from there all values are fitted.
    """
    own = written(values.select(F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count("*").cast("double").alias("n")))
    low, high = own.agg(F.min("x"), F.max("x")).first()
    bin_ = F.floor((F.col("x") - low) / ((high - low) or 1.0) * SUMMARY)
    few = own.groupBy(bin_.alias("bin")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n")).orderBy("bin").toPandas()
    x, n = few["x"].to_numpy(), few["n"].to_numpy()
    _, best = max((_started_modes(x, n, seed + i, START_ROUNDS, 1e-4) for i in range(starts)), key=lambda fit: fit[0])
    modes = sorted(_fitted_modes(own, best, 200, 1e-4)[1])
    (m1, v1, w1), (m2, v2, w2) = modes
    a, b, c = 1 / v2 - 1 / v1, 2 * (m1 / v1 - m2 / v2), m2 * m2 / v2 - m1 * m1 / v1 + 2 * math.log(w1 / w2 * math.sqrt(v2 / v1))
    disc = b * b - 4 * a * c
    roots = [-c / b] if abs(a) < 1e-12 else [(-b + s * math.sqrt(disc)) / (2 * a) for s in (1, -1)] if disc >= 0 else []
    inside = [r for r in roots if m1 < r < m2]
    return values.sparkSession.createDataFrame([(m1, m2, inside[0] if inside else None)], "low double, high double, cut double")
