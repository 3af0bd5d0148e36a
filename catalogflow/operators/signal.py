"""Waveforms as arrays: kernels in column expressions, spectra and correlations in numpy batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def demeaned(data: Column) -> Column:
    mean = F.aggregate(data, F.lit(0.0), lambda a, x: a + x) / F.size(data)
    return F.transform(data, lambda x: x - mean)


def norm(data: Column) -> Column:
    return F.sqrt(F.aggregate(data, F.lit(0.0), lambda a, x: a + x * x))


def tapered(data: Column, share: float = 0.05) -> Column:
    """Cosine taper over a share of each end."""
    n = F.size(data)
    edge = F.greatest(F.floor(n * share), F.lit(1))
    return F.transform(data, lambda x, i: x * F.when(F.least(i, n - 1 - i) < edge, 0.5 * (1 - F.cos(F.lit(math.pi) * F.least(i, n - 1 - i) / edge))).otherwise(1.0))


def decimated(data: Column, step: int) -> Column:
    """The means of ``step`` samples each, the last of what is left: low-passed before it is thinned."""
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(data), F.lit(1)), F.lit(step)), lambda at: mean(F.slice(data, at, step)))


def interpolated(data: Column, rate: float, new_rate: float) -> Column:
    """Samples at a new rate, linear between the old ones, up to the last of these."""
    n = F.floor((F.size(data) - 1) * (new_rate / rate) + 1e-9).cast("int")

    def value(k: Column) -> Column:
        at = k * (rate / new_rate)
        low = F.least(F.floor(at + 1e-9).cast("int"), F.size(data) - 1)
        return data[low] + (data[F.least(low + 1, F.size(data) - 1)] - data[low]) * F.greatest(at - low, F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), n), value)


def scaled(data: Column) -> Column:
    """Of norm 1; all zero stays."""
    size = norm(data)
    return F.transform(data, lambda x: F.when(size > 0, x / size).otherwise(0.0))


def lag_correlation(a: np.ndarray, b: np.ndarray, most: int) -> tuple[float, float, float]:
    """Best normalised correlation over lags, its sub-sample lag (a parabola through the peak), and the
    correlation at lag 0. Nulls (nan) where a trace is all zero."""
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    if scale == 0:
        return np.nan, np.nan, np.nan
    full = np.correlate(a, b, "full") / scale
    mid = len(b) - 1
    part = full[mid - most : mid + most + 1]
    k = int(part.argmax())
    shift = 0.0
    if 0 < k < len(part) - 1 and (bend := part[k - 1] - 2 * part[k] + part[k + 1]) != 0:
        shift = 0.5 * (part[k - 1] - part[k + 1]) / bend
    return float(part[k]), float(k - most + shift), float(full[mid])


def band_power(traces: DataFrame, *, id: str, data: str, rate: float, low: float, high: float, segment: int) -> DataFrame:
    """id and db: ten times the log10 of the mean spectral power in a band, the median over half-
    overlapping tapered segments."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taper = np.hanning(segment)
        f = np.fft.rfftfreq(segment, 1 / rate)
        band = (f >= low) & (f <= high)
        for frame in frames:
            out = []
            for v in frame[data]:
                x = np.asarray(v, float)
                starts = range(0, max(1, len(x) - segment + 1), segment // 2)
                power = [np.abs(np.fft.rfft((s := x[k : k + segment]) * taper[: len(s)], segment)) ** 2 for k in starts]
                out.append(10 * np.log10(max(1e-300, float(np.median(power, axis=0)[band].mean()))))
            yield pd.DataFrame({id: frame[id], "db": out})

    kind = traces.schema[id].dataType.simpleString()
    return traces.select(id, data).filter(F.col(data).isNotNull()).mapInPandas(run, f"`{id}` {kind}, db double")


def band_passed(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Zero-phase band pass by a smooth window over frequencies."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = 1 / np.sqrt(1 + (low / np.maximum(f, 1e-9)) ** 8) / np.sqrt(1 + (f / high) ** 8)
    return np.fft.irfft(np.fft.rfft(x) * gain, len(x))
