"""Rates with exact intervals, goodness of fit, permutation nulls. Quantiles are computed here."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, max(10.0, 10 * k)
    while gamma_share(k / 2, high / 2) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(k / 2, mid / 2) < p else (low, mid)
    return (low + high) / 2


def poisson_interval(n: int, years: float, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a rate from a count."""
    tail = (1 - level) / 2
    return (chi2_quantile(tail, 2 * n) / 2 / years if n else 0.0), chi2_quantile(1 - tail, 2 * n + 2) / 2 / years


def with_poisson_interval(counts: DataFrame, *, n: str, years: float) -> DataFrame:
    """``rate``, ``low`` and ``high`` for each count."""

    @F.pandas_udf("low double, high double")
    def of(values: pd.Series) -> pd.DataFrame:
        known = {int(v): poisson_interval(int(v), years) for v in values.unique()}
        return pd.DataFrame([known[int(v)] for v in values], columns=["low", "high"])

    return counts.withColumn("rate", F.col(n) / years).withColumn("__i", of(F.col(n))).select("*", "__i.low", "__i.high").drop("__i")


def chi2_p(statistic: float, k: int) -> float:
    return 1 - gamma_share(k / 2, statistic / 2)


def ks_completeness(histogram: DataFrame, *, keys: Sequence[str], bin: str = "m10", count: str = "n", limit: float = 0.1) -> DataFrame:
    """mc: the smallest cutoff from which the distribution is within ``limit`` of exponential (greatest
    difference of the distribution functions), by group of a histogram in tenths."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame.sort_values(bin)
        m, n = h[bin].to_numpy(float) / 10, h[count].to_numpy(float)
        mc = math.nan
        for i in range(len(m)):
            if n[i:].sum() < 20:
                break
            beta = 1 / max(1e-6, (m[i:] * n[i:]).sum() / n[i:].sum() - m[i] + 0.05)
            gap = np.abs(np.cumsum(n[i:]) / n[i:].sum() - (1 - np.exp(-beta * (m[i:] + 0.1 - m[i])))).max()
            if gap < limit:
                mc = m[i]
                break
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), mc]], columns=[*keys, "mc"])

    fields = ", ".join(f"`{k}` {histogram.schema[k].dataType.simpleString()}" for k in keys)
    return histogram.select(*keys, bin, count).groupBy(*keys).applyInPandas(run, f"{fields}, mc double")


#: Counts from which numpy draws no hypergeometric numbers; so many events are permuted one by one.
DRAWN = 1_000_000_000


def permutation_null(cells: DataFrame, *, zone: str, bin: str, count: str, times: int = 199, seed: int = 0) -> DataFrame:
    """Observed mean Hellinger distance between zones over bins, and the share of label permutations that
    reach it. The input is one row a cell of a contingency table, so it is small; the cells of a permutation are
    drawn from their distribution (hypergeometric, zone by zone), so work does not go with the counts."""

    def distance(table: np.ndarray) -> float:
        p = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
        i, j = np.triu_indices(len(p), 1)
        return float(np.sqrt(np.maximum(0, 1 - (p[i] * p[j]).sum(axis=1))).mean())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index=zone, columns=bin, values=count, fill_value=0).to_numpy(float)
        rng, seen = np.random.default_rng(seed), distance(table)
        sizes, totals = table.sum(axis=1).astype(int), table.sum(axis=0).astype(int)
        beaten = 0
        for _ in range(times):
            if totals.sum() < DRAWN:
                left, parts = totals.copy(), []
                for size in sizes:
                    parts.append(rng.multivariate_hypergeometric(left, size, method="marginals"))
                    left = left - parts[-1]
            else:
                mixed = np.split(rng.permutation(np.repeat(np.arange(len(totals)), totals)), np.cumsum(sizes)[:-1])
                parts = [np.bincount(x, minlength=len(totals)) for x in mixed]
            beaten += distance(np.array(parts, float)) >= seen
        return pd.DataFrame([[seen, (beaten + 1) / (times + 1)]], columns=["distance", "p"])

    return cells.select(zone, bin, count).groupBy(F.lit(0).alias("__one")).applyInPandas(run, "distance double, p double")
