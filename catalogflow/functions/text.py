"""Codes, keys and fixed-width records as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_dot(station: Column) -> Column:
    """NET.STA of NET.STA. (assignments write a dot at the end)."""
    return F.regexp_replace(station, r"\.+$", "")


def with_dot(station: Column) -> Column:
    return F.concat(without_dot(station), F.lit("."))


def network(station: Column) -> Column:
    return F.split(station, r"\.", 2)[0]


def code(station: Column) -> Column:
    return F.split(station, r"\.", 2)[1]


def base_code(epoch_code: Column) -> Column:
    """Code without the letter of its epoch (only codes of one letter and three digits have one)."""
    return F.when(epoch_code.rlike(r"^N\d{3}[a-z]$"), F.regexp_replace(epoch_code, "[a-z]$", "")).otherwise(epoch_code)


def character(number: Column) -> Column:
    """The character of a code point; ``char`` takes it modulo 256."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def channel_key(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def epoch_unit(key: Column, ordinal: Column) -> Column:
    return F.concat(key, F.lit("@e"), ordinal.cast("string"))


def first_band(bands: Column, order: tuple[str, ...] = ("HH", "EL", "HG")) -> Column:
    """The first band of the order that a slash-joined set holds; null if none."""
    have = F.split(bands, "/")
    return F.coalesce(*(F.when(F.array_contains(have, b), b) for b in order))


def weight_code(probability: Column, phase: Column, bins: tuple[float, ...] = (0.8, 0.6, 0.4, 0.0)) -> Column:
    """0 to 3 by probability; S one worse, at most 3; without a probability 3."""
    own = F.lit(3)
    for k in reversed(range(len(bins))):
        own = F.when(probability >= bins[k], k).otherwise(own)
    own = F.when(probability.isNull(), 3).otherwise(own)
    return F.least(F.when(phase == "S", own + 1).otherwise(own), F.lit(3))


def station_card(net: Column, sta: Column, lat: Column, lon: Column, elev: Column) -> Column:
    """Fixed-width station line: degrees and minutes with their hemispheres, metres."""
    d1, d2 = F.floor(F.abs(lat)), F.floor(F.abs(lon))
    m1, m2 = (F.abs(lat) - d1) * 60, (F.abs(lon) - d2) * 60
    north, east = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.concat(F.rpad(sta, 5, " "), F.lit(" "), F.rpad(net, 2, " "), F.lit("  HHZ  "), F.format_string("%2d %7.4f", d1.cast("int"), m1), north, F.format_string("%3d %7.4f", d2.cast("int"), m2), east, F.format_string("%4d", F.bround(elev).cast("int")))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return F.size(F.array_intersect(left, right)) / F.greatest(F.size(F.array_union(left, right)), F.lit(1))
