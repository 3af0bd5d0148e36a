"""Times as columns. Timestamps without zone are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def from_unix_seconds(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def korean(ts: Column) -> Column:
    """Wall clock nine hours ahead."""
    return ts + F.expr("INTERVAL 9 HOURS")


def event_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def day_of_year_text(ts: Column) -> Column:
    return F.lpad(F.dayofyear(ts).cast("string"), 3, "0")


def year_by_days(ts: Column) -> Column:
    """year + (day of year - 1) / 365.25"""
    return F.year(ts) + (F.dayofyear(ts) - 1) / 365.25


def decimal_year(ts: Column) -> Column:
    """Year and the share of it that has passed, by that year's length."""
    start = F.make_date(F.year(ts), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    end = F.make_date(F.year(ts) + 1, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.year(ts) + (micros(ts) - micros(start)) / (micros(end) - micros(start))


def hour_of_day(ts: Column) -> Column:
    """Hours with fraction."""
    return F.pmod(micros(ts), F.lit(DAY_US)) / 3.6e9


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)
