"""Shared parts of the SQL that checks the queries: derived points, their legs on the walking axis, and fragments."""

from __future__ import annotations

POINTS = """
ev AS (
  SELECT user_id, event_id, value, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn,
         epoch_us(ts) // 1000 AS ms,
         lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM events),
ev2 AS (
  SELECT *, CAST(sum(CASE WHEN ms - before > 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS segment_idx
  FROM ev),
points AS (
  SELECT CAST(user_id AS VARCHAR) AS track_id, segment_idx,
         CAST(row_number() OVER (PARTITION BY user_id, segment_idx ORDER BY ts, event_id) - 1 AS INTEGER) AS point_idx,
         45.0::DOUBLE + (user_id % 40) * 0.05::DOUBLE + rn * 0.0005::DOUBLE + (event_id * 7 % 11) * 0.00002::DOUBLE AS lat,
         6.0::DOUBLE + (user_id % 60) * 0.05::DOUBLE + (event_id * 13 % 17) * 0.00003::DOUBLE AS lon,
         CASE WHEN event_id % 13 <> 0 THEN 800.0::DOUBLE + value * 0.1::DOUBLE END AS ele,
         1704067200000 + (ms - 1704067200000) // 600 AS time_ms
  FROM ev2)"""

_F = "(1 / 298.257223563::DOUBLE)"
_A, _B = "6378137.0::DOUBLE", f"(6378137.0::DOUBLE * (1 - {_F}))"


def inverse(source: str, name: str, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 10) -> str:
    """CTEs that add distance and bearing to the rows of source: a fixed number of steps of the iteration, enough for
    points that are not nearly opposite."""
    out = [
        f"""{name}_0 AS MATERIALIZED (
  SELECT *, atan((1 - {_F}) * tan(radians({lat1}))) AS u1, atan((1 - {_F}) * tan(radians({lat2}))) AS u2,
         radians({lon2} - {lon1}) AS span, radians({lon2} - {lon1}) AS lam
  FROM {source})"""
    ]
    for k in range(steps):
        out.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (lam, east, north, cos_s, sin_s, sigma, sin_a, cos_sq, cos_2m, c),
         span + (1 - c) * {_F} * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m * cos_2m - 1))) AS lam
  FROM (SELECT *, {_F} / 16 * cos_sq * (4 + {_F} * (4 - 3 * cos_sq)) AS c FROM (
    SELECT *, CASE WHEN cos_sq = 0 THEN 0 ELSE cos_s - 2 * sin(u1) * sin(u2) / cos_sq END AS cos_2m FROM (
      SELECT *, 1 - sin_a * sin_a AS cos_sq FROM (
        SELECT *, CASE WHEN sin_s = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / sin_s END AS sin_a, atan2(sin_s, cos_s) AS sigma FROM (
          SELECT *, sqrt(east * east + north * north) AS sin_s FROM (
            SELECT *, cos(u2) * sin(lam) AS east, cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam) AS north,
                   sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM {name}_{k})))))))""")
    last = f"{name}_{steps}"
    out.append(f"""{name} AS (
  SELECT * EXCLUDE (u1, u2, span, lam, east, north, cos_s, sin_s, sigma, sin_a, cos_sq, cos_2m, uu, ka, kb),
         CASE WHEN sin_s = 0 THEN 0.0 WHEN sin_s IS NULL THEN NULL ELSE {_B} * ka * (sigma - kb * sin_s * (cos_2m + kb / 4 * (cos_s * (2 * cos_2m * cos_2m - 1)
           - kb / 6 * cos_2m * (4 * sin_s * sin_s - 3) * (4 * cos_2m * cos_2m - 3)))) END AS distance,
         CASE WHEN sin_s = 0 THEN 0.0 ELSE CASE WHEN atan2(east, north) < 0 THEN degrees(atan2(east, north)) + 360 ELSE degrees(atan2(east, north)) END END AS bearing
  FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb FROM (
    SELECT *, cos_sq * ({_A} * {_A} - {_B} * {_B}) / ({_B} * {_B}) AS uu, CASE WHEN cos_sq = 0 THEN 0 ELSE cos_s - 2 * sin(u1) * sin(u2) / cos_sq END AS cos_2m FROM (
      SELECT *, 1 - sin_a * sin_a AS cos_sq FROM (
        SELECT *, CASE WHEN sin_s = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / sin_s END AS sin_a, atan2(sin_s, cos_s) AS sigma FROM (
          SELECT *, sqrt(east * east + north * north) AS sin_s FROM (
            SELECT *, cos(u2) * sin(lam) AS east, cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam) AS north,
                   sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM {last})))))))""")
    return ",\n".join(out)


_BEFORE = """
before AS (
  SELECT *, lag(lat) OVER s AS prev_lat, lag(lon) OVER s AS prev_lon, lag(ele) OVER s AS prev_ele, lag(time_ms) OVER s AS prev_time_ms
  FROM points WINDOW s AS (PARTITION BY track_id, segment_idx ORDER BY point_idx))"""

_AXIS = """
located AS (
  SELECT * EXCLUDE (distance), coalesce(distance, 0) AS leg_m,
         coalesce(sum(coalesce(distance, 0)) OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_start_m
  FROM measured),
axis AS (SELECT *, cum_start_m + leg_m AS cum_end_m FROM located)"""

LEGS = POINTS + "," + _BEFORE + ",\n" + inverse("before", "measured", "prev_lat", "prev_lon", "lat", "lon") + "," + _AXIS


def climb(values: str, order: str, threshold: float = 3.0) -> str:
    """An aggregate: struct (r, g, l) of the reference, gain and loss of values in an order."""
    first = f"list({{'r': {values}, 'g': 0.0::DOUBLE, 'l': 0.0::DOUBLE}} ORDER BY {order}) FILTER (WHERE {values} IS NOT NULL)"
    return f"""list_reduce({first}, lambda a, x: {{
      'r': CASE WHEN abs(x.r - a.r) > {threshold} THEN x.r ELSE a.r END,
      'g': a.g + CASE WHEN x.r - a.r > {threshold} THEN x.r - a.r ELSE 0 END,
      'l': a.l + CASE WHEN a.r - x.r > {threshold} THEN a.r - x.r ELSE 0 END}})"""


def tobler(metres: str, rise: str) -> str:
    """Seconds for a stretch."""
    kmh = f"greatest(0.05, 6 * exp(-3.5 * abs(coalesce({rise}, 0) / nullif({metres}, 0) + 0.05)))"
    return f"CASE WHEN {metres} <= 0 THEN 0 ELSE {metres} / ({kmh} / 3.6) END"


def band(grade: str) -> str:
    return f"""CASE WHEN {grade} IS NULL OR isnan({grade}) OR isinf({grade}) THEN 'UNKNOWN' WHEN {grade} < -15 THEN 'STEEP_DESCENT'
      WHEN {grade} < -7 THEN 'DESCENT' WHEN {grade} < -3 THEN 'GENTLE_DESCENT' WHEN {grade} < 3 THEN 'FLAT'
      WHEN {grade} < 7 THEN 'GENTLE_CLIMB' WHEN {grade} < 15 THEN 'CLIMB' ELSE 'STEEP_CLIMB' END"""


def difficulty(metres: str, gain: str) -> str:
    e = f"({metres} / 1000 + {gain} / 100)"
    return f"CASE WHEN {e} < 10 THEN 'EASY' WHEN {e} < 20 THEN 'MODERATE' WHEN {e} < 40 THEN 'HARD' WHEN {e} < 70 THEN 'SEVERE' ELSE 'EXTREME' END"


def slerp(t: str, lat1: str, lon1: str, lat2: str, lon2: str) -> tuple[str, str]:
    """Latitude and longitude on the great circle."""
    p, q = [(f"cos(radians({a})) * cos(radians({o}))", f"cos(radians({a})) * sin(radians({o}))", f"sin(radians({a}))") for a, o in ((lat1, lon1), (lat2, lon2))]
    omega = "acos(least(1, greatest(-1, " + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")))"
    x, y, z = (f"({i} * sin((1 - {t}) * {omega}) / sin({omega}) + {j} * sin({t} * {omega}) / sin({omega}))" for i, j in zip(p, q, strict=True))
    flat = f"{t} <= 0 OR ({t} < 1 AND {omega} < 1e-12)"
    return (
        f"CASE WHEN {flat} THEN {lat1} WHEN {t} >= 1 THEN {lat2} ELSE degrees(atan2({z}, sqrt({x} * {x} + {y} * {y}))) END",
        f"CASE WHEN {flat} THEN {lon1} WHEN {t} >= 1 THEN {lon2} ELSE degrees(atan2({y}, {x})) END",
    )
