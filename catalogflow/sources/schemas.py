"""Schemas of the relations; every reader gives these columns and types."""

from __future__ import annotations

#: Fixed column names of the files that are read.
PICKS = "station string, phase string, peak_time timestamp, probability double"
EVENTS = "idx long, time timestamp, x double, y double, z double, picks int, latitude double, longitude double, depth double"
ASSIGNMENTS = "event_idx long, pick_idx long, residual double, station string, phase string, time double"
STATIONS = "Network string, Code string, Latitude double, Longitude double, Elevation double"

#: Fixed order of the relocation table's columns.
RELOCATED = ("id", "lat", "lon", "depth", "x", "y", "z", "ex", "ey", "ez", "yr", "mo", "dy", "hr", "mi", "sc", "mag", "nccp", "nccs", "nctp", "ncts", "rcc", "rct", "cid")
#: Fixed names that older files use.
ALIASES = {"lat": "latitude", "lon": "longitude", "dep": "depth"}
