"""Distances, projections and travel times as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

#: Layer tops (km) with P and S speeds (km/s).
MODELS = {
    "three_layer": [(0.0, 5.98, 3.40), (15.0, 6.38, 3.79), (32.0, 7.95, 4.58)],
    "four_layer": [(0.0, 5.63, 3.40), (7.29, 6.17, 3.60), (20.70, 6.58, 3.70), (31.30, 7.77, 4.45)],
}


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, km_per_degree: float = 111.19) -> Column:
    """Equirectangular distance at the first point's latitude."""
    return F.hypot((lat2 - lat1) * km_per_degree, (lon2 - lon1) * km_per_degree * F.cos(F.radians(lat1)))


def local_km(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north of a reference point."""
    return (lon - lon0) * 111.32 * F.cos(F.radians(lat0)), (lat - lat0) * 110.574


def azimuth_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from the first point to the second, 0 to 360 from north by east."""
    east = (lon2 - lon1) * F.cos(F.radians(lat1))
    return F.pmod(F.degrees(F.atan2(east, lat2 - lat1)) + 360, F.lit(360.0))


def layer_speed(depth: Column, phase: Column, model: str = "three_layer") -> Column:
    """Speed at a depth; a depth on an interface has the lower layer's."""
    out = F.lit(None).cast("double")
    for top, p, s in MODELS[model]:
        own = F.when(phase == "S", s).otherwise(p)
        out = own if top == 0.0 else F.when(depth >= top, own).otherwise(out)
    return out


def slant_seconds(epicentral_km: Column, depth: Column, phase: Column, model: str = "three_layer") -> Column:
    """Straight ray at the source layer's speed."""
    return F.hypot(epicentral_km, depth) / layer_speed(depth, phase, model)


def first_arrival_seconds(epicentral_km: Column, phase_index: int, model: str = "four_layer", depth: float = 0.0) -> Column:
    """First of the direct wave and the head waves under each layer, for a source in the top layer at a
    fixed depth (flat layers)."""
    layers = MODELS[model]
    v0 = layers[0][phase_index]
    waves = [F.hypot(epicentral_km, F.lit(depth)) / v0]
    for r in range(1, len(layers)):
        v = layers[r][phase_index]
        delay, offset = 0.0, 0.0
        for i in range(r):
            thick, vi = layers[i + 1][0] - layers[i][0], layers[i][phase_index]
            legs = 2 * thick - (depth if i == 0 else 0.0)
            cos = (1 - (vi / v) ** 2) ** 0.5
            delay += legs * cos / vi
            offset += legs * (vi / v) / cos
        waves.append(F.when(epicentral_km >= offset, epicentral_km / v + delay))
    return F.least(*waves)


def local_magnitude(amplitude_mm: Column, hypocentral_km: Column, law: str = "regional") -> Column:
    """log10 of the amplitude plus the distance correction; fixed coefficients of the two laws."""
    if law == "regional":
        correction = 1.450676 * F.log10(hypocentral_km / 17) - 0.000661 * (hypocentral_km - 17) + 2.0
    else:
        correction = 0.5107 * F.log10(hypocentral_km / 100) + 0.001699 * (hypocentral_km - 100) + 3.0
    return F.log10(amplitude_mm) + correction


def moment_nm(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * magnitude + 9.1)


def source_radius_m(magnitude: Column, stress_drop_pa: float = 3e6) -> Column:
    """Radius of a circular crack with a constant stress drop."""
    return F.pow(7.0 / 16.0 * moment_nm(magnitude) / stress_drop_pa, F.lit(1.0 / 3.0))


#: Semi-major axis (m) and flattening of WGS84.
WGS84 = (6378137.0, 1 / 298.257223563)


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the WGS84 ellipsoid: Vincenty's iteration on whole batches. Nearly antipodal points, where it
    does not settle, are null."""

    @F.pandas_udf("double")
    def of(a1: pd.Series, o1: pd.Series, a2: pd.Series, o2: pd.Series) -> pd.Series:
        a, f = WGS84
        b = a * (1 - f)
        u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x.to_numpy(float)))) for x in (a1, a2))
        far = np.radians(o2.to_numpy(float) - o1.to_numpy(float))
        su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
        lam, moved = far.copy(), np.full(len(far), np.inf)
        with np.errstate(invalid="ignore", divide="ignore"):
            for _ in range(100):
                sl, cl = np.sin(lam), np.cos(lam)
                ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
                cs = su1 * su2 + cu1 * cu2 * cl
                sigma = np.arctan2(ss, cs)
                sa = np.where(ss > 0, cu1 * cu2 * sl / np.where(ss > 0, ss, 1), 0)
                ca2 = 1 - sa * sa
                c2m = np.where(ca2 > 1e-15, cs - 2 * su1 * su2 / np.where(ca2 > 1e-15, ca2, 1), 0)
                c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
                after = far + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m * c2m - 1)))
                moved, lam = np.abs(after - lam), after
                if not (moved > 1e-13).any():
                    break
        v2 = ca2 * (a * a - b * b) / (b * b)
        big = 1 + v2 / 16384 * (4096 + v2 * (v2 * (320 - 175 * v2) - 768))
        small = v2 / 1024 * (256 + v2 * (v2 * (74 - 47 * v2) - 128))
        shift = small * ss * (c2m + small / 4 * (cs * (2 * c2m * c2m - 1) - small / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        return pd.Series(np.where(moved > 1e-11, np.nan, b * big * (sigma - shift) / 1000))

    found = of(*(x.cast("double") for x in (lat1, lon1, lat2, lon2)))
    return F.when(~F.isnan(found), found)


def utm_km(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """East and north (km) of a transverse Mercator zone of the northern half: Krueger's series to the third
    power of the third flattening, good to a millimetre within the zone."""
    a, f = WGS84
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    sine, turn = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum((k * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, k in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((k * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, k in enumerate(alpha)), F.lit(0.0))
    return 500 + 0.9996 * radius / 1000 * east, 0.9996 * radius / 1000 * north


def to_precision(value: Column, width: float = 0.1) -> Column:
    """The nearest multiple of a width, halves to the even one."""
    return F.bround(value / width) * width
