"""Directions and geodesy: Column expressions, and numpy kernels for what iterates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)


def direction(x: Column, y: Column) -> Column:
    """Degrees clockwise from north of the vector (x, y), in -180..180."""
    return F.degrees(F.atan2(x, y))


def spin90(x: Column) -> Column:
    """A bearing turned by -90 degrees."""
    return F.when(x - 90 < -180, x + 270).otherwise(x - 90)


def bearing_to(u: Column, v: Column) -> Column:
    """Where a wind blows to, in (0, 360]; calm counts as 90."""
    d = F.degrees(F.atan2(u, v))
    return F.when((u == 0) & (v == 0), F.lit(90.0)).when(d <= 0, d + 360).otherwise(d)


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def aspect(lat: Column, res: float = 1e-5) -> Column:
    """Height by width of a small cell: 1 / sqrt(cos lat1 * cos lat2), infinite at the poles."""
    c = F.greatest(F.cos(F.radians(lat)) * F.cos(F.radians(lat + res)), F.lit(0.0))
    return F.when(c == 0, F.lit(float("inf"))).otherwise(1 / F.sqrt(F.when(c == 0, F.lit(1.0)).otherwise(c)))


def haversine_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a = F.sin(F.radians(y2 - y1) / 2) ** 2 + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.sin(F.radians(x2 - x1) / 2) ** 2
    return 2 * 6378.137 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def np_aspect(lat: np.ndarray, res: float = 1e-5) -> np.ndarray:
    c = np.maximum(np.cos(np.radians(lat)) * np.cos(np.radians(lat + res)), 0)
    with np.errstate(divide="ignore"):
        return 1 / np.sqrt(c)


def np_rhumb(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Bearing of the loxodrome, 0..360."""
    dx = np.radians(np.asarray(lon2, float) - lon1)
    dx = np.where(dx > np.pi, dx - 2 * np.pi, np.where(dx < -np.pi, dx + 2 * np.pi, dx))
    with np.errstate(divide="ignore"):
        psi = [np.log(np.tan(np.radians(np.asarray(y, float)) / 2 + np.pi / 4)) for y in (lat1, lat2)]
    return np.degrees(np.arctan2(dx, psi[1] - psi[0])) % 360


def np_inverse(lon1, lat1, lon2, lat2) -> tuple[np.ndarray, np.ndarray]:
    """(metres, initial bearing in -180..180) on WGS84 by Vincenty's iteration; great circles for nearly antipodal points."""
    lon1, lat1, lon2, lat2 = (np.asarray(a, float) for a in np.broadcast_arrays(lon1, lat1, lon2, lat2))
    u1, u2 = (np.arctan((1 - FLAT) * np.tan(np.radians(y))) for y in (lat1, lat2))
    gap = (np.radians(lon2 - lon1) + np.pi) % (2 * np.pi) - np.pi
    lam = gap.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            ss = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cs = s1 * s2 + c1 * c2 * np.cos(lam)
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, c1 * c2 * np.sin(lam) / np.where(ss == 0, 1, ss))
            ca2 = 1 - sa**2
            c2m = np.where(ca2 == 0, 0, cs - 2 * s1 * s2 / np.where(ca2 == 0, 1, ca2))
            c = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            new = gap + (1 - c) * FLAT * sa * (sig + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
            moved, lam = np.abs(new - lam), new
            if not (moved > 1e-13).any():
                break
    usq = ca2 * (A**2 - B**2) / B**2
    k1 = 1 + usq / 16384 * (4096 + usq * (usq * (320 - 175 * usq) - 768))
    k2 = usq / 1024 * (256 + usq * (usq * (74 - 47 * usq) - 128))
    ds = k2 * ss * (c2m + k2 / 4 * (cs * (2 * c2m**2 - 1) - k2 / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
    dist = B * k1 * (sig - ds)
    az = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
    lost = (moved > 1e-9) | ~np.isfinite(dist)
    if lost.any():
        y1, y2, d = np.radians(lat1), np.radians(lat2), gap
        a = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin(d / 2) ** 2
        dist = np.where(lost, 2 * A * np.arcsin(np.sqrt(np.minimum(1, a))), dist)
    same = (lon1 == lon2) & (lat1 == lat2)
    return np.where(same, 0.0, dist), np.where(same, np.nan, az)


def geodesic(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct(km, azimuth): distance and initial bearing (null for equal points) between points in degrees; null where a coordinate is."""

    @F.pandas_udf("km double, azimuth double")
    def kernel(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
        m, az = np_inverse(x1.to_numpy(float), y1.to_numpy(float), x2.to_numpy(float), y2.to_numpy(float))
        return pd.DataFrame({"km": pd.Series(m / 1000).astype(object).where(~np.isnan(m), None), "azimuth": pd.Series(az).astype(object).where(~np.isnan(az), None)})

    return kernel(x1, y1, x2, y2)


#: Equal Earth projection (EPSG:8857) by its published polynomial.
_EE = (1.340264, -0.081106, 0.000893, 0.003796)
_R = 6371007.1809


def np_equal_earth(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arcsin(np.sqrt(3) / 2 * np.sin(np.radians(lat)))
    a1, a2, a3, a4 = _EE
    x = _R * 2 * np.sqrt(3) * np.radians(lon) * np.cos(t) / (3 * (9 * a4 * t**8 + 7 * a3 * t**6 + 3 * a2 * t**2 + a1))
    return x, _R * (a4 * t**9 + a3 * t**7 + a2 * t**3 + a1 * t)


def np_equal_earth_inverse(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a1, a2, a3, a4 = _EE
    t = y / _R
    for _ in range(12):
        t = t - (a4 * t**9 + a3 * t**7 + a2 * t**3 + a1 * t - y / _R) / (9 * a4 * t**8 + 7 * a3 * t**6 + 3 * a2 * t**2 + a1)
    lon = 3 * x / _R * (9 * a4 * t**8 + 7 * a3 * t**6 + 3 * a2 * t**2 + a1) / (2 * np.sqrt(3) * np.cos(t))
    return np.degrees(lon), np.degrees(np.arcsin(np.clip(2 * np.sin(t) / np.sqrt(3), -1, 1)))


def equal_earth_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of projected metres, by Newton steps on the parametric latitude."""
    a1, a2, a3, a4 = _EE
    slope = lambda t: 9 * a4 * F.pow(t, F.lit(8)) + 7 * a3 * F.pow(t, F.lit(6)) + 3 * a2 * t * t + a1
    height = lambda t: a4 * F.pow(t, F.lit(9)) + a3 * F.pow(t, F.lit(7)) + a2 * F.pow(t, F.lit(3)) + a1 * t
    t = F.aggregate(F.sequence(F.lit(1), F.lit(12)), y / _R, lambda t, _: t - (height(t) - y / _R) / slope(t))
    one = lambda v: F.transform(F.array(t), v)[0]  # noqa: E731  t is worked out once for each use
    lon = one(lambda t: F.degrees(3 * x / _R * slope(t) / (2 * F.sqrt(F.lit(3.0)) * F.cos(t))))
    return lon, one(lambda t: F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.sin(t) / F.sqrt(F.lit(3.0)))))))
