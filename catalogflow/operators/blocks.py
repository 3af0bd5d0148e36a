"""All pairs of a group without a row a pair: rows are dealt to blocks of bounded size, each pair of blocks
is a task, and only what the task makes of its pairs leaves it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Work of a pair of blocks: from two frames and whether they are one and the same, a frame.
Work = Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]


def meet(rows: DataFrame, work: Work, schema: str, *, id: str, keys: Sequence[str] = (), size: int = 2_000) -> DataFrame:
    """What ``work`` makes of each pair of blocks of about ``size`` rows of equal ``keys``.

    Each row goes to as many tasks as its group has blocks: a group of n rows moves n * n / size of
    them and compares n * n / 2 pairs, in numpy.
    """
    keys = list(keys) or ["__one"]
    own = rows if keys != ["__one"] else rows.withColumn("__one", F.lit(0))
    many = own.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("__many"))
    dealt = own.join(many, keys).withColumn("__own", F.pmod(F.xxhash64(id), F.col("__many")).cast("int")).withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__many") - 1)))
    dealt = dealt.withColumn("__i", F.least("__own", "__j")).withColumn("__j", F.greatest("__own", "__j"))
    names = rows.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = frame["__i"].iloc[0], frame["__j"].iloc[0]
        a = frame[frame["__own"] == i][names]
        if i == j:
            return work(a, a, True)
        b = frame[frame["__own"] == j][names]
        return work(a, b, False) if len(a) and len(b) else pd.DataFrame()  # a block of a small group may be empty

    return dealt.groupBy(*keys, "__i", "__j").applyInPandas(run, schema)


def correlation_integral(points: DataFrame, *, id: str, coords: Sequence[str], radii: Sequence[float]) -> DataFrame:
    """radius, n (pairs closer than it) and share of all pairs, over all pairs of points."""
    edges = np.array(sorted(radii), float)

    def work(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = a[list(coords)].to_numpy(float), b[list(coords)].to_numpy(float)
        counts = np.zeros(len(edges) + 1, np.int64)
        for at in range(0, len(x), 500):
            apart = np.sqrt(sum((x[at : at + 500, None, k] - y[None, :, k]) ** 2 for k in range(x.shape[1])))
            if same:
                apart = apart[np.arange(at, min(at + 500, len(x)))[:, None] < np.arange(len(y))[None, :]]
            counts += np.bincount(np.searchsorted(edges, apart.ravel(), "right"), minlength=len(edges) + 1)
        return pd.DataFrame({"radius": edges, "n": np.cumsum(counts)[:-1]})

    total = points.agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    found = meet(points.select(id, *coords), work, "radius double, n long", id=id).groupBy("radius").agg(F.sum("n").alias("n"))
    return found.join(F.broadcast(total)).select("radius", "n", (F.col("n") / F.col("pairs")).alias("share"))


def excitation(events: DataFrame, *, t: str, m: str, mu: float, k: float, alpha_ln10: float, c: float, p: float, reference: float) -> DataFrame:
    """t and ``rate``: mu plus what every earlier event adds, k * 10^(alpha (m - reference)) * (dt + c)^-p.

    Events of one time are one row before they meet the others.
    """
    weight = k * F.pow(F.lit(10.0), alpha_ln10 * (F.col(m) - reference))
    own = events.groupBy(F.col(t).cast("double").alias("t")).agg(F.sum(weight).alias("w"))

    def work(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        def added(late: pd.DataFrame, early: pd.DataFrame) -> pd.DataFrame:
            dt = late["t"].to_numpy()[:, None] - early["t"].to_numpy()[None, :]
            return pd.DataFrame({"t": late["t"], "add": np.where(dt > 0, np.maximum(dt, 0) + c, 1.0) ** -p * (dt > 0) @ early["w"].to_numpy()})

        return added(a, b) if same else pd.concat([added(a, b), added(b, a)])

    return meet(own, work, "t double, add double", id="t").groupBy("t").agg((F.sum("add") + mu).alias("rate"))


def compensator(events: DataFrame, *, t: str, m: str, mu: float, k: float, alpha_ln10: float, c: float, p: float, reference: float) -> DataFrame:
    """``expected``: the integral of the rate from the first to the last event; ``n``: their number."""
    span = events.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    weight = k * F.pow(F.lit(10.0), alpha_ln10 * (F.col(m) - reference))
    grown = (c ** (1 - p) - F.pow(F.col("t1") - F.col(t) + c, F.lit(1 - p))) / (p - 1)
    own = events.join(F.broadcast(span))
    return own.agg(F.count("*").alias("n"), (mu * F.first(F.col("t1") - F.col("t0")) + F.sum(weight * grown)).alias("expected"))


def fitted(events: DataFrame, *, t: str, m: str, alpha_ln10: float, c: float, p: float, reference: float, rounds: int = 6, points: int = 32) -> tuple[float, float, float, DataFrame]:
    """The likeliest mu and k of :func:`excitation` for a given kernel, the log likelihood, and (t, rate,
    background) of each time: background = mu / rate is the probability that an event there has no parent.

    The sums over earlier events do not hang on mu and k, so they are made once. At the best pair the expected
    number is the number of events, which gives k for each mu; along that line the likelihood is concave, and
    each of ``rounds`` aggregations finds between which two of ``points`` values of mu its slope turns.
    """
    kernel = {"alpha_ln10": alpha_ln10, "c": c, "p": p, "reference": reference}
    sums = excitation(events, t=t, m=m, mu=0.0, k=1.0, **kernel).withColumnRenamed("rate", "s")
    own = events.groupBy(F.col(t).cast("double").alias("t")).agg(F.count("*").alias("n")).join(sums, "t").checkpoint()
    whole = compensator(events, t=t, m=m, mu=0.0, k=1.0, **kernel).first().expected
    span = events.agg((F.max(t) - F.min(t)).cast("double")).first()[0]
    count = own.agg(F.sum("n")).first()[0]
    low, high = 0.0, count / span
    for _ in range(rounds):
        tried = [low + (high - low) * i / (points + 1) for i in range(1, points + 1)]
        slopes = own.agg(*(F.sum(F.col("n") * (1 - F.col("s") * span / whole) / (x + (count - x * span) / whole * F.col("s"))) for x in tried)).first()
        up = sum(v > 0 for v in slopes)
        low, high = ([low, *tried][up], [*tried, high][up])
    mu = (low + high) / 2
    k = (count - mu * span) / whole
    rate = F.lit(mu) + k * F.col("s")
    likelihood = own.agg(F.sum(F.col("n") * F.log(rate))).first()[0] - mu * span - k * whole
    return mu, k, likelihood, own.select("t", rate.alias("rate"), (mu / rate).alias("background"))


def units(*vectors: pd.Series) -> list[np.ndarray]:
    """Matrices of the vectors at norm 1 (nan, if theirs is 0); shorter ones end in zeros."""
    width = max(v.map(len).max() for v in vectors)
    found = []
    for own in vectors:
        out = np.zeros((len(own), width))
        for i, v in enumerate(own):
            out[i, : len(v)] = v
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        found.append(out / np.where(norm > 0, norm, np.nan))
    return found


def _correlated(x: np.ndarray, y: np.ndarray, shifts: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Largest correlation over the shifts, its shift, smallest, and that at the first shift."""
    width = x.shape[1]
    best = lag = low = zero = None
    for s in shifts:
        cc = x[:, max(s, 0) : width + min(s, 0)] @ y[:, max(-s, 0) : width - max(s, 0)].T
        if best is None:
            best, low, zero, lag = cc.copy(), cc.copy(), cc, np.zeros(cc.shape, np.int64)
        else:
            lag[cc > best + 1e-12] = s
            best, low = np.maximum(best, cc), np.minimum(low, cc)
    return best, lag, low, zero


def _shifts(lags: int) -> list[int]:
    return sorted(range(-lags, lags + 1), key=lambda s: (abs(s), s))


def similar(traces: DataFrame, *, id: str, data: str, keys: Sequence[str] = (), lags: int = 0, least: float | None = None, most: float | None = None, top: int | None = None) -> DataFrame:
    """a, b (a < b), cc (the largest normalised correlation over shifts of up to ``lags``), lag (its shift of
    a against b, the smallest in size and then value if several), cc0 (at shift 0) and cc_neg (the
    smallest) of pairs of traces of equal ``keys``.

    Pairs leave a task if cc reaches ``least``, if cc0 is at most ``most``, or as the ``top`` smallest cc0 of
    the task; without any of them, all do. Traces of norm 0 meet none; shorter ones end in zeros.
    """
    shifts = _shifts(lags)
    kind = traces.schema[id].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = units(a["v"], b["v"])
        out = []
        for at in range(0, len(x), 500):
            part = x[at : at + 500]
            best, lag, low, zero = _correlated(part, y, shifts)
            keep = ~np.isnan(zero)
            if same:
                keep &= np.arange(at, at + len(part))[:, None] < np.arange(len(y))[None, :]
            if least is not None:
                keep &= best >= least
            if most is not None:
                keep &= zero <= most
            i, j = np.nonzero(keep)
            if top is not None and len(i) > top:
                few = np.argpartition(zero[i, j], top)[:top]
                worst = zero[i, j][few].max()
                i, j = (z[zero[i, j] <= worst] for z in (i, j))
            out.append(pd.DataFrame({"a": a["id"].to_numpy()[at + i], "b": b["id"].to_numpy()[j], "cc": best[i, j], "lag": lag[i, j], "cc0": zero[i, j], "cc_neg": low[i, j]}))
        pairs = pd.concat(out)
        turned = pairs["a"] > pairs["b"]
        pairs.loc[turned, ["a", "b"]] = pairs.loc[turned, ["b", "a"]].to_numpy()
        pairs.loc[turned, "lag"] *= -1
        return pairs

    own = traces.filter(F.col(data).isNotNull()).select(F.col(id).alias("id"), *keys, F.col(data).cast("array<double>").alias("v"))
    return meet(own, work, f"a {kind}, b {kind}, cc double, lag long, cc0 double, cc_neg double", id="id", keys=keys)


def reversed_in_all(traces: DataFrame, *, id: str, data: Sequence[str], keys: Sequence[str] = (), lags: int = 0, most: float, below: float) -> DataFrame:
    """a, b (a < b), worst (the largest correlation at shift 0 of the columns ``data``) and cc_pos (the largest at
    any shift of up to ``lags``) of pairs of equal ``keys`` with worst at most ``most`` and cc_pos under ``below``.

    All columns of a pair meet in one task, so no pair leaves it that one column alone would keep. A null or a
    norm of 0 in any column meets none.
    """
    shifts, names = _shifts(lags), [f"v{k}" for k in range(len(data))]
    kind = traces.schema[id].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        parts = [units(a[v], b[v]) for v in names]
        first, second, out = a["id"].to_numpy(), b["id"].to_numpy(), []
        for at in range(0, len(a), 500):
            worst, best = None, None
            for x, y in parts:
                cc, _, _, zero = _correlated(x[at : at + 500], y, shifts)
                worst, best = (zero, cc) if worst is None else (np.maximum(worst, zero), np.maximum(best, cc))
            keep = (worst <= most) & (best < below)  # nan is neither
            if same:
                keep &= np.arange(at, at + len(worst))[:, None] < np.arange(len(second))[None, :]
            i, j = np.nonzero(keep)
            out.append(pd.DataFrame({"a": np.minimum(first[at + i], second[j]), "b": np.maximum(first[at + i], second[j]), "worst": worst[i, j], "cc_pos": best[i, j]}))
        return pd.concat(out)

    there = " AND ".join(f"`{c}` IS NOT NULL" for c in data)
    own = traces.filter(there).select(F.col(id).alias("id"), *keys, *(F.col(c).cast("array<double>").alias(v) for c, v in zip(data, names, strict=True)))
    return meet(own, work, f"a {kind}, b {kind}, worst double, cc_pos double", id="id", keys=keys)


def links(traces: DataFrame, *, id: str, data: str, keys: Sequence[str] = (), least: float) -> DataFrame:
    """a, b: of the pairs of equal ``keys`` whose correlation reaches ``least`` those of a spanning forest of each
    pair of blocks, so they have the components of all such pairs; a task gives fewer than it has rows."""
    kind = traces.schema[id].dataType.simpleString()

    def work(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y = units(a["v"], b["v"])
        first, second = a["id"].to_numpy(), b["id"].to_numpy()
        label = np.arange(len(second) + (0 if same else len(first)))  # the second rows, then the first
        own, out = (0 if same else len(second)), []
        for at in range(0, len(x), 500):
            near = x[at : at + 500] @ y.T >= least
            for i, row in enumerate(near, at):
                met = np.flatnonzero(row & (label[: len(second)] != label[own + i]))
                if len(met):
                    told, one = np.unique(label[met], return_index=True)
                    out += [(first[i], second[j]) for j in met[one]]
                    label[np.isin(label, told)] = label[own + i]
        found = np.array(out, dtype=first.dtype).reshape(-1, 2)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    own = traces.filter(F.col(data).isNotNull()).select(F.col(id).alias("id"), *keys, F.col(data).cast("array<double>").alias("v"))
    return meet(own, work, f"a {kind}, b {kind}", id="id", keys=keys)


def mean_within(traces: DataFrame, *, data: str, keys: Sequence[str]) -> DataFrame:
    """keys, n and mean_cc: the mean correlation at shift 0 over all pairs of a group's traces, from the sum
    of their unit vectors alone: (|sum|^2 - n) / (n * (n - 1)). Traces of norm 0 count in n, with 0."""
    v = F.col(data).cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = traces.select(*keys, F.posexplode(F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0))).alias("at", "x"))
    sums = unit.groupBy(*keys, "at").agg(F.sum("x").alias("x")).groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    there = traces.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(size > 0).alias("sound"))
    return there.join(sums, list(keys)).select(*keys, "n", F.when(F.col("n") > 1, (F.col("square") - F.col("sound")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cc"))


def log_radii(first: float, last: float, many: int) -> list[float]:
    return [10 ** (math.log10(first) + i * (math.log10(last) - math.log10(first)) / (many - 1)) for i in range(many)]
