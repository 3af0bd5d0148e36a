"""Hooks for models and solvers: picking over traces, location of events, a damping loop. A model or solver
is a function; a simple one of each kind is here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PICKED = "station string, phase string, us long, probability double"
LOCATED = "event_idx long, us long, x double, y double, z double, rms double, n int"

#: Picks of a trace: from samples, their rate and the phase names, (phase, seconds, probability).
Picker = Callable[[np.ndarray, float], list[tuple[str, float, float]]]


def energy_ratio(short_s: float = 0.5, long_s: float = 5.0, on: float = 4.0, off: float = 1.5, phase: str = "P") -> Picker:
    """Picks where the mean energy over the last ``short_s`` rises to ``on`` times that over the
    ``long_s`` before; the next one only after it fell to ``off``. The probability grows with the ratio."""

    def run(x: np.ndarray, rate: float) -> list[tuple[str, float, float]]:
        short, long = max(1, round(short_s * rate)), max(2, round(long_s * rate))
        if len(x) < short + long:
            return []
        sums = np.append(0, np.cumsum((x - x.mean()) ** 2))
        ends = np.arange(long + short, len(x) + 1)
        ratio = (sums[ends] - sums[ends - short]) / short / np.maximum((sums[ends - short] - sums[ends - short - long]) / long, 1e-30)
        found, armed = [], True
        for k in np.flatnonzero((ratio >= on) | (ratio <= off)).tolist():
            if ratio[k] <= off:
                armed = True
            elif armed:
                armed = False
                found.append((phase, float(ends[k] - 1) / rate, float(1 - on / (on + ratio[k]))))
        return found

    return run


def pick(traces: DataFrame, picker: Picker, *, least: float = 0.3, station: str = "station", start: str = "us", rate: str = "rate", data: str = "data") -> DataFrame:
    """station, phase, us and probability of what ``picker`` finds in each trace (start in microseconds),
    from the probability ``least`` on. The picker goes to the workers once; traces pass in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, at, r, x in zip(frame[station], frame[start], frame[rate], frame[data], strict=True):
                rows += [(name, phase, int(at + round(s * 1e6)), p) for phase, s, p in picker(np.asarray(x, float), float(r)) if p >= least]
            yield pd.DataFrame(rows, columns=["station", "phase", "us", "probability"])

    return traces.filter(f"`{data}` IS NOT NULL").select(station, start, rate, data).mapInPandas(run, PICKED)


#: Arrivals of a task of :func:`locate`, about; their bytes are few beside the solver's work.
ARRIVALS = 100_000

#: Events that the grid locator holds the nodes of at once, times their arrivals.
HELD = 100


def grid_locator(*, speed: Mapping[str, float], box: tuple[tuple[float, float], ...], steps: int = 9, rounds: int = 5) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The node of a grid over ``box`` (x, y, z ranges) with the least rms of arrival residuals, straight
    rays at constant speeds; the grid closes in round the best node ``rounds`` times. The origin time is
    the mean of arrivals less travel times. Events of equally many arrivals are located together."""
    edges = np.array(box, float)

    def closed(t: np.ndarray, v: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, ...]:
        """Origin in seconds, place and rms of events, all (events, arrivals)."""
        ranges, own = np.repeat(edges[None], len(t), axis=0), np.arange(len(t))
        for _ in range(rounds):
            lo, hi = ranges[:, :, 0], ranges[:, :, 1]
            axes = np.linspace(lo, hi, steps, axis=-1)  # events, 3, steps
            dx, dy = ((axes[:, k, None, :] - s[:, :, None]) ** 2 for k, s in ((0, sx), (1, sy)))  # events, arrivals, steps
            deep = (axes[:, 2] ** 2)[:, None, None, :]
            late = [(t[:, i, None, None, None] - np.sqrt((dx[:, i, :, None] + dy[:, i, None, :])[..., None] + deep) / v[:, i, None, None, None]).reshape(len(t), -1) for i in range(t.shape[1])]
            origin = sum(late) / len(late)
            rms = np.sqrt(sum((x - origin) ** 2 for x in late) / len(late))
            k = rms.argmin(axis=1)
            node = np.stack([axes[own, c, i] for c, i in enumerate(np.unravel_index(k, (steps,) * 3))], axis=1)
            step = (hi - lo) / (steps - 1)
            ranges = np.clip(np.stack([node - step, node + step], axis=2), edges[None, :, :1], edges[None, :, 1:])
        return origin[own, k], node, rms[own, k]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        starts = np.flatnonzero(np.append(True, frame["event_idx"].to_numpy()[1:] != frame["event_idx"].to_numpy()[:-1]))
        counts = np.diff(np.append(starts, len(frame)))
        us, sx, sy = frame["us"].to_numpy(np.int64), frame["sx"].to_numpy(float), frame["sy"].to_numpy(float)
        v, out = frame["phase"].map(speed).to_numpy(float), []
        for n in np.unique(counts):
            same = starts[counts == n]
            for at in range(0, len(same), max(1, HELD // int(n))):
                rows = same[at : at + max(1, HELD // int(n)), None] + np.arange(n)
                first = us[rows].min(axis=1)
                origin, node, rms = closed((us[rows] - first[:, None]) / 1e6, v[rows], sx[rows], sy[rows])
                out.append(pd.DataFrame({"event_idx": frame["event_idx"].to_numpy()[rows[:, 0]], "us": first + np.rint(origin * 1e6).astype(np.int64), **dict(zip("xyz", node.T, strict=True)), "rms": rms, "n": np.full(len(rows), n, np.int32)}))
        return pd.concat(out, ignore_index=True)

    return run


def locate(arrivals: DataFrame, solver: Callable[[pd.DataFrame], pd.DataFrame], *, least: int = 4) -> DataFrame:
    """What ``solver`` gives for the events' arrivals (event_idx, us, phase, sx, sy), from ``least`` on. An event's
    arrivals are gathered in order as one row; a solver gets those of many events one after the other, and
    gives a row an event."""
    from pyspark.sql import functions as F

    parts = ["us", "phase", "sx", "sy"]
    many = max(4 * arrivals.sparkSession.sparkContext.defaultParallelism, arrivals.count() // ARRIVALS)
    own = arrivals.repartition(many, "event_idx").groupBy("event_idx").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("a")).filter((F.size("a") >= least) & F.col("event_idx").isNotNull()).select("event_idx", *(F.col("a")[p].alias(p) for p in parts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                counts = frame["us"].map(len).to_numpy()
                yield solver(pd.DataFrame({"event_idx": np.repeat(frame["event_idx"].to_numpy(), counts), **{p: np.concatenate(frame[p].to_list()) for p in parts}}))

    return own.mapInPandas(run, LOCATED)


def damped(solve: Callable[[float], tuple[float, DataFrame]], *, first: float, band: tuple[float, float], most: int = 12) -> tuple[float, float, DataFrame]:
    """Damping, condition and result of a solver run until its condition number falls into ``band``: damping is
    doubled or halved until the band lies between two runs, then bisected (geometrically)."""
    damping, low, high = first, None, None
    for _ in range(most):
        condition, found = solve(damping)
        if band[0] <= condition <= band[1]:
            break
        if condition > band[1]:
            low = damping
            damping = damping * 2 if high is None else (damping * high) ** 0.5
        else:
            high = damping
            damping = damping / 2 if low is None else (low * damping) ** 0.5
    return damping, condition, found
