"""From readings to event magnitudes and the completeness and slope of their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import stats


def event_magnitudes(readings: DataFrame, *, snr: float = 2.0, cap: float = 60.0, least: int = 3) -> DataFrame:
    """Median magnitude and its spread by event. Readings under ``snr`` are left out; those beyond ``cap``
    km count as seen (n_total) but not as used. status is ok from ``least`` used ones on."""
    ml = F.when(F.col("dist") <= cap, F.col("ml"))
    own = readings.filter(F.col("snr") >= snr).withColumn("ml", ml)
    return own.groupBy("event_idx").agg(
        F.percentile("ml", 0.5).alias("magnitude"), F.avg("ml").alias("mean"), F.stddev_samp("ml").alias("std"), F.count("ml").alias("n_used"), F.count("*").alias("n_total"), F.percentile("snr", 0.5).alias("snr"),
        F.when(F.count("ml") >= least, "ok").otherwise("low_snr").alias("status"),
    )


def mc_and_b(events: DataFrame, *, magnitude: str) -> DataFrame:
    """mc (fullest bin plus 0.2), and b and n of the events from it on."""
    mc = stats.completeness(events, magnitude=magnitude)
    return events.join(F.broadcast(mc), F.col(magnitude) >= F.col("mc")).groupBy("mc").agg(F.round(1 / (stats.LN10 * (F.avg(magnitude) - F.first("mc") + 0.05)), 6).alias("b"), F.count("*").alias("n"))
