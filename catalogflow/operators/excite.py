"""The kernel of self-exciting models: all five parameters by expectation and maximisation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import meet
from .written import dropped, written

NAMES = ("mu", "k", "alpha_ln10", "c", "p")


def _grown(left: np.ndarray, c: float, p: float) -> np.ndarray:
    """The integral of (s + c)^-p over s from 0 to ``left``."""
    if abs(p - 1) < 1e-9:
        return np.log((left + c) / c)
    return (c ** (1 - p) - (left + c) ** (1 - p)) / (p - 1)


def _parents(days: DataFrame, alpha: float, cs: list[float], p: float) -> DataFrame:
    """For each time, over all earlier ones: the kernel's sum, and that weighted by magnitude and by log(dt + c)
    for each of ``cs``, of which the middle one is the kernel's."""
    c = cs[len(cs) // 2]
    names = ["a", "v", *(f"l{i}" for i in range(len(cs)))]

    def work(one: pd.DataFrame, two: pd.DataFrame, same: bool) -> pd.DataFrame:
        def added(late: pd.DataFrame, early: pd.DataFrame) -> pd.DataFrame:
            dt = late["t"].to_numpy()[:, None] - early["t"].to_numpy()[None, :]
            after = dt > 0
            dt = np.where(after, dt, 1.0)
            g = np.where(after, (dt + c) ** -p, 0.0)
            w, v = early["w"].to_numpy(), early["v"].to_numpy()
            sums = [g @ w, g @ v, *((g * np.log(dt + x)) @ w for x in cs)]
            return pd.DataFrame({"t": late["t"].to_numpy(), **dict(zip(names, sums, strict=True))})

        return added(one, two) if same else pd.concat([added(one, two), added(two, one)])

    met = meet(days.select("t", "w", "v"), work, "t double, " + ", ".join(f"{n} double" for n in names), id="t", size=1_000)
    return met.groupBy("t").agg(*(F.sum(n).alias(n) for n in names))


def _expected(days: DataFrame, alphas: int, cs: list[float], ps: list[float], last: float) -> np.ndarray:
    """The kernel's integral over all events up to the last time, for each weight w0, w1, ..., c and p."""
    places = list(itertools.product(range(alphas), range(len(cs)), range(len(ps))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((alphas, len(cs), len(ps)))
        for frame in frames:
            w = frame[[f"w{i}" for i in range(alphas)]].to_numpy()
            left = last - frame["t"].to_numpy()
            total += np.stack([np.stack([w.T @ _grown(left, c, p) for p in ps], axis=1) for c in cs], axis=1)
        yield pd.DataFrame([(*at, total[at]) for at in places], columns=["i", "j", "k", "value"])

    out = np.zeros((alphas, len(cs), len(ps)))
    for r in days.select("t", *(f"w{i}" for i in range(alphas))).mapInPandas(run, "i int, j int, k int, value double").groupBy("i", "j", "k").agg(F.sum("value").alias("value")).collect():
        out[r.i, r.j, r.k] = r.value
    return out


def kernel_fitted(events: DataFrame, *, t: str, m: str, reference: float, start: tuple[float, float, float, float, float] | None = None, rounds: int = 60, tolerance: float = 1e-8) -> tuple[dict[str, float], list[float], DataFrame]:
    """mu, k, alpha_ln10, c and p of :func:`blocks.excitation`, the log likelihood at each round, and
    (t, rate, background) of each time.

    Each round every event is shared out between the background and its earlier events, in proportion to what
    they add to the rate. Tasks on pairs of blocks of times add up what the shares need: their number, and
    their magnitudes and log delays; no pair is a row. Given the shares, mu and k have a closed form, and
    (alpha, c, p) go to the best of the values next to the present ones, which stay if none is better. So
    the likelihood never falls. Steps that bring nothing are halved; the rounds end when all are small and the
    likelihood rests.

    Events of one time are one row before they meet the others, and are no parents of one another. Events
    without a time or magnitude take no part.
    """
    own = written(events.select(F.col(t).cast("double").alias("t"), (F.col(m).cast("double") - reference).alias("m")).dropna())
    span = own.agg(F.min("t"), F.max("t"), F.count("*")).first()
    first, last, count = span
    if not count or last <= first:
        raise ValueError("a kernel needs events of two times at least")
    mu, k, alpha, c, p = start or (0.5 * count / (last - first), 0.0, 0.8, (last - first) / count, 1.2)
    steps, told = [0.2, 1.0, 0.1], []  # of alpha, of the logarithm of c, and of p
    while True:
        alphas = [alpha - steps[0], alpha, alpha + steps[0]]
        cs = [c * math.exp(s * steps[1]) for s in (-1, 0, 1)]
        ps = [max(0.2, p - steps[2]), p, p + steps[2]]
        power = lambda a: F.pow(F.lit(10.0), a * F.col("m"))
        days = written(own.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.col("m") * power(alpha)).alias("v"), *(F.sum(power(a)).alias(f"w{i}") for i, a in enumerate(alphas))).withColumn("w", F.col("w1")))
        whole = _expected(days, 3, cs, ps, last)
        if not told and not start:
            k = 0.5 * count / whole[1, 1, 1]
        sums = days.select("t", "n").join(_parents(days, alpha, cs, p), "t", "left").fillna(0.0)
        rate = F.lit(mu) + k * F.col("a")
        share = lambda x: F.sum(F.col("n") * k * F.col(x) / rate)  # noqa: B023, E731
        found = sums.agg(F.sum(F.col("n") * F.log(rate)).alias("log"), F.sum(F.col("n") * mu / rate).alias("alone"), share("a").alias("born"), share("v").alias("size"), *(share(f"l{i}").alias(f"l{i}") for i in range(3))).first()
        told.append(found.log - mu * (last - first) - k * whole[1, 1, 1])
        resting = len(told) > 1 and told[-1] - told[-2] < tolerance * abs(told[-1])
        if len(told) > rounds or (resting and max(steps) < 0.02):
            break
        mu = found.alone / (last - first)
        # given the shares: born * ln k + ... - k * whole, at its best k = born / whole
        gain = {at: -found.born * math.log(whole[at]) + math.log(10) * alphas[at[0]] * found.size - ps[at[2]] * found[f"l{at[1]}"] for at in itertools.product(range(3), repeat=3)}
        best = max(gain, key=lambda at: (gain[at], at == (1, 1, 1)))
        k, alpha, c, p = found.born / whole[best], alphas[best[0]], cs[best[1]], ps[best[2]]
        steps = [s / 2 if at == 1 and s > 0.005 else s for s, at in zip(steps, best, strict=True)]
        dropped(days)
    dropped(own)
    return dict(zip(NAMES, (mu, k, alpha, c, p), strict=True)), told, sums.select("t", rate.alias("rate"), (mu / rate).alias("background"))
