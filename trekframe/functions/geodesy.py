"""Geodesy on the WGS84 ellipsoid and on the sphere, as columns.

Distances and bearings between points iterate (inverse and direct problem after Vincenty); they are Arrow-batched
functions that iterate a whole batch at once until every row has converged.  All else is built-in expressions.
Invalid or missing coordinates give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ellipsoid, the mean Earth radius, and the limits of the iterations.
SEMI_MAJOR = 6_378_137.0
FLATTENING = 1 / 298.257223563
SEMI_MINOR = SEMI_MAJOR * (1 - FLATTENING)
MEAN_RADIUS = 6_371_008.8
MOST_STEPS = 200


def _series(u_squared):
    """The two coefficients that both problems expand."""
    a = 1 + u_squared / 16384 * (4096 + u_squared * (-768 + u_squared * (320 - 175 * u_squared)))
    b = u_squared / 1024 * (256 + u_squared * (-128 + u_squared * (74 - 47 * u_squared)))
    return a, b


def _arc_correction(b, sin_s, cos_s, cos_2m):
    inner = cos_s * (2 * cos_2m**2 - 1) - b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)
    return b * sin_s * (cos_2m + b / 4 * inner)


def _longitude_shift(c, sin_alpha, sigma, sin_s, cos_s, cos_2m):
    return (1 - c) * FLATTENING * sin_alpha * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))


def _valid(lat, lon):
    return np.isfinite(lat) & np.isfinite(lon) & (np.abs(lat) <= 90) & (np.abs(lon) <= 180)


def inverse_arrays(lat1, lon1, lat2, lon2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance in metres, initial and final bearing in degrees of arrays of points."""
    lat1, lon1, lat2, lon2 = (np.asarray(x, dtype=np.float64) for x in (lat1, lon1, lat2, lon2))
    ok = _valid(lat1, lon1) & _valid(lat2, lon2)
    out = np.where(ok, 0.0, np.nan)
    distance, first, last = out.copy(), out.copy(), out.copy()
    left = np.flatnonzero(ok & ~((lat1 == lat2) & (lon1 == lon2)))
    # Reduced latitudes and the difference of longitudes the short way round.
    span = np.radians(lon2[left] - lon1[left])
    span = np.where(span > np.pi, span - 2 * np.pi, np.where(span < -np.pi, span + 2 * np.pi, span))
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat1[left])))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat2[left])))
    lam = span.copy()
    with np.errstate(all="ignore"):
        for _ in range(MOST_STEPS):
            if not len(left):
                break
            s1, c1, s2, c2, sl, cl = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), np.sin(lam), np.cos(lam)
            east, north = c2 * sl, c1 * s2 - s1 * c2 * cl
            sin_s, cos_s = np.sqrt(east**2 + north**2), s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_alpha = np.where(sin_s == 0, 0.0, c1 * c2 * sl / sin_s)
            cos_sq = 1 - sin_alpha**2
            cos_2m = np.where(cos_sq == 0, 0.0, cos_s - 2 * s1 * s2 / np.where(cos_sq == 0, 1.0, cos_sq))
            c = FLATTENING / 16 * cos_sq * (4 + FLATTENING * (4 - 3 * cos_sq))
            moved = span + _longitude_shift(c, sin_alpha, sigma, sin_s, cos_s, cos_2m)
            same = sin_s == 0
            done = same | (np.abs(moved - lam) <= 1e-15 + 1e-13 * np.abs(moved))
            if done.any():
                at = left[done]
                a, b = _series(cos_sq[done] * (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2)
                arc = sigma[done] - _arc_correction(b, sin_s[done], cos_s[done], cos_2m[done])
                sl, cl = np.sin(moved[done]), np.cos(moved[done])
                s1, c1, s2, c2 = s1[done], c1[done], s2[done], c2[done]
                distance[at] = np.where(same[done], 0.0, SEMI_MINOR * a * arc)
                first[at] = np.where(same[done], 0.0, np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360)
                last[at] = np.where(same[done], 0.0, np.degrees(np.arctan2(c1 * sl, c1 * s2 * cl - s1 * c2)) % 360)
                left, u1, u2, span, moved = left[~done], u1[~done], u2[~done], span[~done], moved[~done]
            lam = moved
    if len(left):  # nearly opposite points: the sphere
        p1, p2, dl = np.radians(lat1[left]), np.radians(lat2[left]), np.radians(lon2[left] - lon1[left])
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
        distance[left] = 2 * MEAN_RADIUS * np.arcsin(np.minimum(1.0, np.sqrt(h)))
        bearing = np.degrees(np.arctan2(np.sin(dl) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dl))) % 360
        first[left] = last[left] = bearing
    return distance, first, last


def direct_arrays(lat, lon, bearing, metres) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude reached from points along bearings; NaN for invalid starts or negative distances."""
    lat, lon, bearing, metres = np.broadcast_arrays(*(np.asarray(x, dtype=np.float64) for x in (lat, lon, bearing, metres)))
    ok = _valid(lat, lon) & np.isfinite(bearing) & (metres >= 0)
    alpha, u1 = np.radians(bearing), np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))
    sa, ca, s1, c1 = np.sin(alpha), np.cos(alpha), np.sin(u1), np.cos(u1)
    with np.errstate(all="ignore"):
        sigma1, sin_alpha = np.arctan2(np.tan(u1), ca), c1 * sa
        cos_sq = 1 - sin_alpha**2
        a, b = _series(cos_sq * (SEMI_MAJOR**2 - SEMI_MINOR**2) / SEMI_MINOR**2)
        start = metres / (SEMI_MINOR * a)
        sigma = start.copy()
        for _ in range(MOST_STEPS):
            cos_2m = np.cos(2 * sigma1 + sigma)
            moved = start + _arc_correction(b, np.sin(sigma), np.cos(sigma), cos_2m)
            done = np.abs(moved - sigma) <= 1e-15 + 1e-13 * np.abs(moved)
            sigma = moved
            if np.all(done | ~ok):
                break
        sin_s, cos_s, cos_2m = np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma)
        aside = s1 * sin_s - c1 * cos_s * ca
        to_lat = np.degrees(np.arctan2(s1 * cos_s + c1 * sin_s * ca, (1 - FLATTENING) * np.sqrt(sin_alpha**2 + aside**2)))
        lam = np.arctan2(sin_s * sa, c1 * cos_s - s1 * sin_s * ca)
        c = FLATTENING / 16 * cos_sq * (4 + FLATTENING * (4 - 3 * cos_sq))
        to_lon = lon + np.degrees(lam - _longitude_shift(c, sin_alpha, sigma, sin_s, cos_s, cos_2m))
        to_lon = np.where((to_lon > -180) & (to_lon <= 180), to_lon, 180 - (180 - to_lon) % 360)
    still = metres == 0
    return np.where(ok, np.where(still, lat, to_lat), np.nan), np.where(ok, np.where(still, lon, to_lon), np.nan)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def _nullable(x: np.ndarray) -> pd.Series:
    return pd.Series(x).astype("Float64").mask(np.isnan(x)) if np.isnan(x).any() else pd.Series(x)


@F.pandas_udf(_doubles("distance", "initial_bearing", "final_bearing"))
def _inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
    names = ("distance", "initial_bearing", "final_bearing")
    return pd.DataFrame({k: _nullable(v) for k, v in zip(names, inverse_arrays(lat1, lon1, lat2, lon2), strict=True)})


@F.pandas_udf(_doubles("lat", "lon"))
def _direct(lat: pd.Series, lon: pd.Series, bearing: pd.Series, metres: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({k: _nullable(v) for k, v in zip(("lat", "lon"), direct_arrays(lat, lon, bearing, metres), strict=True)})


def inverse(lat1, lon1, lat2, lon2) -> Column:
    """Struct of distance (m), initial_bearing and final_bearing (degrees)."""
    return _inverse(lat1, lon1, lat2, lon2)


def distance(lat1, lon1, lat2, lon2) -> Column:
    return _inverse(lat1, lon1, lat2, lon2)["distance"]


def destination(lat, lon, bearing, metres) -> Column:
    """Struct of lat and lon."""
    return _direct(lat, lon, bearing, metres)


def is_valid(lat: Column, lon: Column) -> Column:
    """Whether coordinates are there, finite and in range."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))  # NaN is above all numbers


def arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """What positions between two points need to be found: a struct of both points, their unit vectors and the angle between."""
    xyz = [(F.cos(F.radians(a)) * F.cos(F.radians(o)), F.cos(F.radians(a)) * F.sin(F.radians(o)), F.sin(F.radians(a))) for a, o in ((lat1, lon1), (lat2, lon2))]
    dot = sum((p * q for p, q in zip(*xyz, strict=True)), F.lit(0.0))
    omega = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    fields = {"lat1": lat1, "lon1": lon1, "lat2": lat2, "lon2": lon2, "omega": omega, "sine": F.sin(omega)}
    fields |= {f"{c}{i}": v for i, point in enumerate(xyz, 1) for c, v in zip("xyz", point, strict=True)}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def on_arc(arc: Column, fraction: Column) -> Column:
    """Struct of lat and lon on an arc; exact at both ends."""
    t, omega = F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)), arc["omega"]
    near, far = F.sin((1 - t) * omega) / arc["sine"], F.sin(t * omega) / arc["sine"]
    x, y, z = (arc[f"{c}1"] * near + arc[f"{c}2"] * far for c in "xyz")
    moved = F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"))
    start, end = (F.struct(arc[f"lat{i}"].alias("lat"), arc[f"lon{i}"].alias("lon")) for i in (1, 2))
    return F.when((t == 0) | (omega < 1e-12) & (t < 1), start).when(t == 1, end).otherwise(moved)


def interpolate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, fraction: Column) -> Column:
    """Struct of lat and lon on the great circle between two points; exact at both ends."""
    return on_arc(arc(lat1, lon1, lat2, lon2), fraction)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the mean sphere."""
    up, across = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(across), 2)
    return 2 * MEAN_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def normalize_degrees(x: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def normalize_longitude(x: Column) -> Column:
    """Into (-180, 180]."""
    return F.when((x > -180) & (x <= 180), x).otherwise(180 - F.pmod(180 - x, F.lit(360.0)))


def normalize_longitude_delta(x: Column) -> Column:
    """Into [-180, 180], both ends kept."""
    return F.when((x >= -180) & (x <= 180), x).otherwise(normalize_longitude(x))


def metres_per_degree_latitude(lat: Column) -> Column:
    phi = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi) - 0.0023 * F.cos(6 * phi)


def metres_per_degree_longitude(lat: Column) -> Column:
    phi = F.radians(lat)
    return 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)


def local_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar metres at the mean latitude."""
    mid = (lat1 + lat2) / 2
    dx = normalize_longitude_delta(lon2 - lon1) * metres_per_degree_longitude(mid)
    return F.hypot(dx, (lat2 - lat1) * metres_per_degree_latitude(mid))


def local_deviation(start: tuple, end: tuple, point: tuple) -> Column:
    """Struct of metres from a point to a segment and the fraction along it; each argument is (lat, lon)."""
    mid = (start[0] + end[0] + point[0]) / 3
    sx, sy = metres_per_degree_longitude(mid), metres_per_degree_latitude(mid)
    bx, by = normalize_longitude_delta(end[1] - start[1]) * sx, (end[0] - start[0]) * sy
    px, py = normalize_longitude_delta(point[1] - start[1]) * sx, (point[0] - start[0]) * sy
    square = bx * bx + by * by
    along = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / F.nullif(square, F.lit(0.0)))))
    return F.struct(F.hypot(px - bx * along, py - by * along).alias("metres"), along.alias("fraction"))
