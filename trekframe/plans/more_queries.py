"""The other half of the registered queries: sampling, transforms, terrain, GeoJSON, flyover, files and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as geo
from ..functions import scalars as sc
from ..operators import dem, flyover, framing, geojson, sampling, transforms
from ..operators import profile as prof
from ..operators import tracks
from ..sources import catalog, gpx
from ..sources.derived import surface_tiles
from . import sql
from .queries import ORACLE_SQL, QUERIES, WITH_STATS, query, r, rounded



def _case(value: str, table: dict[str, str]) -> str:
    """SQL that looks a value up."""
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


# Sampling: every track at its 21 twentieths.

_STRETCHES = f"""
ends AS (
  SELECT *, lag(lat) OVER w AS last_lat, lag(lon) OVER w AS last_lon, lag(ele) OVER w AS last_ele, lag(segment_idx) OVER w AS last_segment,
         sum(leg_m) OVER (PARTITION BY track_id, segment_idx) AS segment_m
  FROM axis WINDOW w AS (PARTITION BY track_id ORDER BY segment_idx, point_idx)),
openings AS (SELECT * EXCLUDE (bearing), bearing AS leg_bearing, CASE WHEN prev_lat IS NULL AND last_segment IS NOT NULL THEN last_lat END AS g_lat FROM ends),
{sql.inverse('openings', 'gapped', 'g_lat', 'last_lon', 'lat', 'lon')},
flown AS (SELECT *, sum(coalesce(distance, 0)) OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx) AS gaps_m FROM gapped),
totals AS (SELECT track_id, max(cum_end_m) AS walk, max(cum_end_m + gaps_m) AS flight FROM flown GROUP BY track_id),
stretches AS (
  SELECT track_id, 'leg' AS kind, segment_idx, segment_idx::DOUBLE AS o1, point_idx, cum_start_m AS walk_m, cum_start_m + gaps_m AS flight_m, leg_m AS length_m,
         coalesce(prev_lat, lat) AS a_lat, coalesce(prev_lon, lon) AS a_lon, CASE WHEN prev_lat IS NULL THEN ele ELSE prev_ele END AS a_ele, lat AS b_lat, lon AS b_lon, ele AS b_ele,
         CASE WHEN prev_lat IS NULL THEN 0 ELSE leg_bearing END AS bearing
  FROM flown WHERE (prev_lat IS NOT NULL AND segment_m > 0) OR (prev_lat IS NULL AND segment_m <= 0)
  UNION ALL
  SELECT track_id, 'gap', last_segment, last_segment + 0.5, point_idx, cum_start_m, cum_start_m + gaps_m - distance, distance,
         last_lat, last_lon, last_ele, lat, lon, ele, bearing
  FROM flown WHERE g_lat IS NOT NULL)"""


def _sample_sql(asked: str, axis: str) -> str:
    """CTE sampled: for asked (track_id, k, d) the last stretch before, and the place on it."""
    only = "WHERE kind = 'leg'" if axis == "walk" else ""
    t = "CASE WHEN length_m > 0 THEN least(1, greatest(0, (d - axis_m) / length_m)) ELSE 0 END"
    lat, lon = sql.slerp("t", "a_lat", "a_lon", "b_lat", "b_lon")
    return f"""
found AS (
  SELECT * FROM (SELECT a.k, least(greatest(a.d, 0), z.{axis}) AS d, s.*, s.{axis}_m AS axis_m, z.walk AS total_walk FROM {asked} a JOIN totals z USING (track_id)
                 JOIN (SELECT * FROM stretches {only}) s ON a.track_id = s.track_id AND s.{axis}_m <= least(greatest(a.d, 0), z.{axis}) + 1e-9)
  QUALIFY row_number() OVER (PARTITION BY track_id, k ORDER BY round(axis_m, 6) DESC, o1 DESC, point_idx DESC) = 1),
placed AS (SELECT *, {t} AS t FROM found),
sampled AS (
  SELECT track_id, k, d, segment_idx, {lat} AS lat, {lon} AS lon, coalesce(a_ele + (b_ele - a_ele) * t, a_ele, b_ele) AS ele,
         CASE WHEN kind = 'gap' THEN walk_m ELSE least(total_walk, walk_m + d - axis_m) END AS walked_m, bearing
  FROM placed)"""


def _twentieths(axis: str) -> str:
    asked = f"asked AS (SELECT track_id, k, {axis} * (k + 0.37::DOUBLE) / 21 AS d FROM totals, range(21) AS x(k))"
    return f"""WITH {sql.LEGS}, {_STRETCHES}, {asked}, {_sample_sql('asked', axis)}
      SELECT track_id, k, {r('lat', 'lon', places=7)}, {r('ele', 'bearing', places=3)}, round(walked_m, 2) AS walked_m, segment_idx FROM sampled"""


def _sampled(points: DataFrame, axis: str) -> DataFrame:
    known = sampling.stretches(points)
    totals = known.groupBy("track_id").agg(F.max(f"total_{axis}_m").alias("t"))
    asked = totals.select("track_id", F.explode(F.sequence(F.lit(0), F.lit(20)).cast("array<bigint>")).alias("k"), "t")
    asked = asked.select("track_id", "k", (F.col("t") * (F.col("k") + 0.37) / 21).alias("distance_m"))
    found = sampling.sample(known, asked, axis)
    places = {"lat": 7, "lon": 7, "ele": 3, "walked_m": 2, "bearing": 3}
    return found.select("track_id", "k", *(F.round(c, n).alias(c) for c, n in places.items()), "segment_idx")


@query("sample_walk", _twentieths("walk"))
def _walk(points: DataFrame) -> DataFrame:
    return _sampled(points, "walk")


@query("sample_flight", _twentieths("flight"))
def _flight(points: DataFrame) -> DataFrame:
    return _sampled(points, "flight")


@query("sample_fractions", _twentieths("walk"))
def _fractions(points: DataFrame) -> DataFrame:
    """The same places as in sample_walk, asked for by shares of the way."""
    known = sampling.stretches(points)
    asked = points.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0), F.lit(20)).cast("array<bigint>")).alias("k"))
    found = sampling.sample_fractions(known, asked.withColumn("fraction", (F.col("k") + 0.37) / 21))
    places = {"lat": 7, "lon": 7, "ele": 3, "walked_m": 2, "bearing": 3}
    return found.select("track_id", "k", *(F.round(c, n).alias(c) for c, n in places.items()), "segment_idx")


# Transforms.


@query(
    "valid_points",
    f"""WITH {sql.POINTS} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', places=7)} FROM points
      WHERE point_idx % 11 NOT IN (2, 3, 5, 7)""",
)
def _valid(points: DataFrame) -> DataFrame:
    """Positions past a pole, past the date line, without a number or missing are left out."""
    turn = F.col("point_idx") % 11
    odd = points.withColumns(
        {
            "lat": F.when(turn == 2, F.lit(90.5)).when(turn == 3, F.lit(float("nan"))).otherwise(F.col("lat")),
            "lon": F.when(turn == 5, F.lit(-180.5)).when(turn != 7, F.col("lon")),
        }
    )
    return rounded(tracks.valid_points(odd).select("track_id", "segment_idx", "point_idx", "lat", "lon"), 7)


@query(
    "reverse_tracks",
    f"""WITH {sql.POINTS} SELECT track_id, CAST(max(segment_idx) OVER t - segment_idx AS INTEGER) AS segment_idx, CAST(max(point_idx) OVER s - point_idx AS INTEGER) AS point_idx,
      {r('lat', 'lon', places=7)}, round(ele, 4) AS ele,
      first_value(time_ms) OVER (s ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        + last_value(time_ms) OVER (s ORDER BY point_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - time_ms AS time_ms
      FROM points WINDOW t AS (PARTITION BY track_id), s AS (PARTITION BY track_id, segment_idx)""",
)
def _reverse(points: DataFrame) -> DataFrame:
    return rounded(transforms.reverse(points).drop("hacc_m"), 7).withColumn("ele", F.round("ele", 4))


@query(
    "merge_tracks",
    f"""WITH {sql.POINTS}, parts AS (SELECT CAST(CAST(track_id AS BIGINT) % 10 AS VARCHAR) AS track_id, CAST(track_id AS BIGINT) // 10 AS part_idx, segment_idx, point_idx, lat, lon FROM points)
      SELECT track_id, CAST(dense_rank() OVER (PARTITION BY track_id ORDER BY part_idx, segment_idx) - 1 AS INTEGER) AS segment_idx, point_idx, {r('lat', 'lon', places=7)} FROM parts""",
)
def _merge(points: DataFrame) -> DataFrame:
    user = F.col("track_id").cast("long")
    parts = points.withColumn("part_idx", F.expr("cast(track_id as bigint) div 10")).withColumn("track_id", (user % 10).cast("string"))
    return rounded(transforms.merge(parts).select("track_id", "segment_idx", "point_idx", "lat", "lon"), 7)


_DENSE_LAT, _DENSE_LON = sql.slerp("t", "prev_lat", "prev_lon", "lat", "lon")
DENSE_SQL = f"""
steps AS (
  SELECT track_id, segment_idx, point_idx, lat, lon, ele, prev_lat, prev_lon, prev_ele, time_ms, unnest(CASE WHEN prev_lat IS NULL THEN [0] WHEN leg_m > 0 THEN range(1, n + 1) ELSE [] END) AS k, n
  FROM (SELECT *, CAST(greatest(1, ceil(leg_m / 25)) AS BIGINT) AS n FROM axis)),
dense AS (
  SELECT track_id, segment_idx, CAST(row_number() OVER (PARTITION BY track_id, segment_idx ORDER BY point_idx, k) - 1 AS INTEGER) AS point_idx,
         CASE WHEN k = 0 THEN lat ELSE {_DENSE_LAT} END AS lat, CASE WHEN k = 0 THEN lon ELSE {_DENSE_LON} END AS lon,
         CASE WHEN k = 0 THEN ele ELSE prev_ele + (ele - prev_ele) * t END AS ele, CASE WHEN k = 0 THEN time_ms END AS time_ms
  FROM (SELECT *, k / n::DOUBLE AS t FROM steps))"""


@query("densify_tracks", f"WITH {sql.LEGS}, {DENSE_SQL} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', places=7)}, round(ele, 6) AS ele, time_ms FROM dense")
def _densify(points: DataFrame) -> DataFrame:
    return rounded(transforms.densify(points).drop("hacc_m"), 7).withColumn("ele", F.round("ele", 6))


#: The first points of a track's segments, and the first of them again, as the points of one segment.
_STOPS = sql.LEGS.replace("points AS (", "recorded AS (", 1).replace(
    sql.POINTS.replace("points AS (", "recorded AS (", 1),
    sql.POINTS.replace("points AS (", "recorded AS (", 1)
    + """, points AS (
  SELECT track_id, 0 AS segment_idx, segment_idx AS point_idx, lat, lon, ele, time_ms FROM recorded WHERE point_idx = 0
  UNION ALL
  SELECT track_id, 0, max(segment_idx) + 1, arg_min(lat, segment_idx), arg_min(lon, segment_idx), arg_min_null(ele, segment_idx), NULL
  FROM recorded WHERE point_idx = 0 GROUP BY track_id HAVING count(*) > 1)""",
    1,
)


@query("closed_loops", f"WITH {_STOPS}, {DENSE_SQL} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', places=7)}, time_ms FROM dense")
def _closed(points: DataFrame) -> DataFrame:
    """One densified segment through the first points of the segments and back to the first."""
    return rounded(transforms.from_waypoints(_waypoints(points), closed=True).drop("hacc_m", "ele"), 7)


THIN_SQL = """
folded AS (
  SELECT track_id, segment_idx, list_reduce(list({'acc': leg_m, 'last': last, 'p': point_idx, 'out': [point_idx]} ORDER BY point_idx), lambda a, x: {
    'acc': CASE WHEN x.last OR a.acc + x.acc >= 200 THEN 0 ELSE a.acc + x.acc END, 'last': x.last, 'p': x.p,
    'out': CASE WHEN x.last OR a.acc + x.acc >= 200 THEN list_append(a.out, x.p) ELSE a.out END}).out AS kept
  FROM (SELECT *, lead(point_idx) OVER (PARTITION BY track_id, segment_idx ORDER BY point_idx) IS NULL AS last FROM axis) GROUP BY track_id, segment_idx),
thinned AS (SELECT a.* FROM axis a JOIN folded f USING (track_id, segment_idx) WHERE list_contains(f.kept, a.point_idx))"""


@query("thin_tracks", f"WITH {sql.LEGS}, {THIN_SQL} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', places=7)} FROM thinned")
def _thin(points: DataFrame) -> DataFrame:
    return rounded(transforms.thin(points, 200.0).select("track_id", "segment_idx", "point_idx", "lat", "lon"), 7)


SIMPLIFY_SQL = f"""WITH RECURSIVE {sql.POINTS},
ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY track_id, segment_idx ORDER BY point_idx) - 1 AS INTEGER) AS o,
         CAST(count(*) OVER (PARTITION BY track_id, segment_idx) AS INTEGER) AS n FROM points),
intervals AS (
  SELECT DISTINCT track_id, segment_idx, 0 AS a, n - 1 AS b FROM ordered
  UNION ALL
  SELECT track_id, segment_idx, unnest([a, w]) AS a, unnest([w, b]) AS b FROM (
    SELECT track_id, segment_idx, a, b, arg_max(o, {{'s': score, 'o': -o}}) AS w, max(score) AS worst FROM (
      SELECT *, greatest(sqrt((px - vx * along) * (px - vx * along) + (py - vy * along) * (py - vy * along)) / 5,
                         coalesce(abs(ele - (ele_a + (ele_b - ele_a) * along)) / 3, 0)) AS score
      FROM (
        SELECT *, CASE WHEN vx * vx + vy * vy > 0 THEN least(1, greatest(0, (px * vx + py * vy) / (vx * vx + vy * vy))) ELSE 0 END AS along FROM (
          SELECT *, (lon_b - lon_a) * east AS vx, (lat_b - lat_a) * north AS vy, (lon - lon_a) * east AS px, (lat - lat_a) * north AS py FROM (
            SELECT *, 111132.92 - 559.82 * cos(2 * phi) + 1.175 * cos(4 * phi) - 0.0023 * cos(6 * phi) AS north,
                   111412.84 * cos(phi) - 93.5 * cos(3 * phi) + 0.118 * cos(5 * phi) AS east FROM (
              SELECT i.track_id, i.segment_idx, i.a, i.b, p.o, p.lat, p.lon, p.ele, x.lat AS lat_a, x.lon AS lon_a, x.ele AS ele_a,
                     y.lat AS lat_b, y.lon AS lon_b, y.ele AS ele_b, radians((x.lat + y.lat + p.lat) / 3) AS phi
              FROM intervals i
              JOIN ordered x ON x.track_id = i.track_id AND x.segment_idx = i.segment_idx AND x.o = i.a
              JOIN ordered y ON y.track_id = i.track_id AND y.segment_idx = i.segment_idx AND y.o = i.b
              JOIN ordered p ON p.track_id = i.track_id AND p.segment_idx = i.segment_idx AND p.o > i.a AND p.o < i.b)))))
    GROUP BY track_id, segment_idx, a, b) WHERE worst > 1),
kept AS (SELECT track_id, segment_idx, a AS o FROM intervals UNION SELECT track_id, segment_idx, b FROM intervals)
SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', 'ele', places=7)} FROM ordered JOIN kept USING (track_id, segment_idx, o)"""


@query("simplify_tracks", SIMPLIFY_SQL)
def _simplify(points: DataFrame) -> DataFrame:
    return rounded(transforms.simplify(points).select("track_id", "segment_idx", "point_idx", "lat", "lon", "ele"), 7)


@query("generate_loops")
def _loops(points: DataFrame) -> DataFrame:
    first = points.filter("segment_idx = 0 and point_idx = 0")
    requests = first.select(
        F.col("track_id").alias("request_id"), "lat", "lon", F.lit(8000.0).alias("target_m"), F.lit(9).alias("control_points"), F.lit(0.28).alias("irregularity"),
        F.lit(37.0).alias("rotation_deg"), F.lit(1).cast("long").alias("seed"), F.lit(10).alias("samples_per_span"), F.lit(25.0).alias("spacing_m"),
    )
    return rounded(transforms.loops(requests).select("track_id", "point_idx", "lat", "lon"), 7)


# Framing.

_CENTRE = f"""
centres AS (
  SELECT track_id, degrees(atan2(z, sqrt(x * x + y * y))) AS c_lat, degrees(atan2(y, x)) AS c_lon
  FROM (SELECT track_id, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM points GROUP BY track_id)),
spokes AS (SELECT p.track_id, p.lat, p.lon, c_lat, c_lon FROM points p JOIN centres USING (track_id)),
{sql.inverse('spokes', 'reach', 'c_lat', 'c_lon', 'lat', 'lon')},
views AS (SELECT track_id, c_lat AS lat, c_lon AS lon, 2 * max(distance) / 1000 AS diagonal_km FROM reach GROUP BY track_id, c_lat, c_lon)"""


@query(
    "track_cameras",
    f"""WITH {sql.POINTS}, {_CENTRE} SELECT track_id, {r('lat', 'lon', 'diagonal_km', places=6)},
      round(CASE WHEN diagonal_km <= 0 THEN 15 ELSE greatest(3, least(15, log2(60000 / diagonal_km))) END, 6) AS zoom, 60.0::DOUBLE AS tilt, 0.0::DOUBLE AS bearing FROM views""",
)
def _cameras(points: DataFrame) -> DataFrame:
    return rounded(framing.cameras(points), 6)


# Terrain: tiles of zoom 13, made of a smooth surface by formula.


def _n(zoom: str) -> str:
    return f"power(2, {zoom})"


_MERCATOR = "(1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2"
TILES_SQL = f"""
tiled AS (
  SELECT p.*, z AS zoom, CAST(floor((lon + 180) / 360 * {_n('z')}) AS INTEGER) AS x, CAST(floor({_MERCATOR.format(lat='lat')} * {_n('z')}) AS INTEGER) AS y
  FROM points p, range(8, 14) AS r(z))"""


@query("tiles_covering", f"WITH {sql.POINTS}, {TILES_SQL} SELECT DISTINCT track_id, CAST(13 AS INTEGER) AS zoom, x, y FROM tiled WHERE zoom = 13")
def _covering(points: DataFrame) -> DataFrame:
    return dem.tiles_covering(points, F.lit(13))


_PIXEL = "(800 + ((x * 256 + least(255, greatest(0, {px}))) * 3 + (y * 256 + least(255, greatest(0, {py}))) * 7) % 97)::DOUBLE"
FILL_SQL = f"""
zooms AS (
  SELECT track_id, max(zoom) AS zoom, arg_max(tiles, zoom) AS tiles
  FROM (SELECT track_id, zoom, count(DISTINCT (x, y)) AS tiles FROM tiled WHERE ele IS NULL GROUP BY track_id, zoom) WHERE tiles <= 64 GROUP BY track_id),
spots AS (
  SELECT t.*, (lon + 180) / 360 * {_n('zoom')} * 256 - x * 256.0::DOUBLE - 0.5 AS cx, {_MERCATOR.format(lat='lat')} * {_n('zoom')} * 256 - y * 256.0::DOUBLE - 0.5 AS cy
  FROM tiled t JOIN zooms USING (track_id, zoom) WHERE ele IS NULL),
corners AS (SELECT *, CAST(floor(cx) AS BIGINT) AS x0, CAST(floor(cy) AS BIGINT) AS y0 FROM spots),
heights AS (
  SELECT *, {_PIXEL.format(px='x0', py='y0')} AS h00, {_PIXEL.format(px='x0 + 1', py='y0')} AS h10, {_PIXEL.format(px='x0', py='y0 + 1')} AS h01, {_PIXEL.format(px='x0 + 1', py='y0 + 1')} AS h11
  FROM corners),
filled AS (SELECT track_id, segment_idx, point_idx, (h00 + (h10 - h00) * (cx - x0)) * (1 - (cy - y0)) + (h01 + (h11 - h01) * (cx - x0)) * (cy - y0) AS ele FROM heights)"""


def _tiles_for(points: DataFrame) -> DataFrame:
    zooms = dem.fill_zooms(points).select("track_id", "zoom")
    missing = points.filter("ele is null").join(zooms, "track_id")
    tile = dem.tile_for(F.col("lat"), F.col("lon"), F.col("zoom"))
    return surface_tiles(missing.select("zoom", tile.alias("t")).select("zoom", "t.*").distinct())


@query(
    "fill_elevation",
    f"""WITH {sql.POINTS}, {TILES_SQL}, {FILL_SQL} SELECT track_id, segment_idx, point_idx, round(ele, 3) AS ele, true AS filled FROM filled
      UNION ALL SELECT track_id, segment_idx, point_idx, round(ele, 3), false FROM points WHERE ele IS NOT NULL""",
)
def _fill(points: DataFrame) -> DataFrame:
    return rounded(dem.fill(points, _tiles_for(points)).select("track_id", "segment_idx", "point_idx", "ele", "filled"), 3)


@query(
    "fill_report",
    f"""WITH {sql.POINTS}, {TILES_SQL}, {FILL_SQL} SELECT track_id, CAST(zoom AS INTEGER) AS zoom, tiles, n AS points_filled
      FROM zooms JOIN (SELECT track_id, count(*) AS n FROM filled GROUP BY track_id) USING (track_id)""",
)
def _report(points: DataFrame) -> DataFrame:
    return dem.fill_report(points, dem.fill(points, _tiles_for(points)))


# GeoJSON: coordinates are compared as numbers, each with its place; the text's form is tested apart.

_SUMS = """round(sum(round_even(lon, 6)), 3) AS lon_sum, round(sum(round_even(lat, 6)), 3) AS lat_sum,
         round(sum(i * (round_even(lon, 6) + 2 * round_even(lat, 6))), 2) AS in_order"""


@query(
    "geojson_tracks",
    f"""WITH {sql.POINTS} SELECT track_id, count(DISTINCT segment_idx) AS n_lines, count(*) AS n_coordinates, {_SUMS}
      FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx) AS i FROM points) GROUP BY track_id""",
)
def _geojson(points: DataFrame) -> DataFrame:
    return _geojson_digest(geojson.encode(points))


def _geojson_digest(found: DataFrame, *keys: str) -> DataFrame:
    """Numbers of lines and coordinates, and their sums (in_order: each times its place), read back from the text."""
    multi = F.get_json_object("geojson", "$.geometry.type") == "MultiLineString"
    inner = F.get_json_object("geojson", "$.geometry.coordinates")
    lines = F.from_json(F.when(multi, inner).otherwise(F.concat(F.lit("["), inner, F.lit("]"))), "array<array<array<double>>>")
    flat = found.withColumn("lines", lines).withColumn("c", F.flatten("lines"))
    total = lambda k: F.round(F.aggregate(F.col("c"), F.lit(0.0), lambda a, x: a + x[k]), 3)
    weighed = F.transform(F.col("c"), lambda x, i: (i + 1) * (x[0] + 2 * x[1]))
    return flat.select(
        "track_id", *keys, F.size("lines").cast("long").alias("n_lines"), F.size("c").cast("long").alias("n_coordinates"), total(0).alias("lon_sum"), total(1).alias("lat_sum"),
        F.round(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x), 2).alias("in_order"),
    )


_CUT_LAT, _CUT_LON = sql.slerp("t", "prev_lat", "prev_lon", "lat", "lon")
REVEAL_SQL = f"""
budgets AS (
  SELECT *, max(cum_end_m) OVER (PARTITION BY track_id) * 0.613::DOUBLE AS budget, min(cum_start_m) OVER s AS part_start, max(cum_end_m) OVER s AS part_end
  FROM axis WINDOW s AS (PARTITION BY track_id, segment_idx)),
shown AS (
  SELECT track_id, segment_idx, point_idx, part_end <= budget AS whole, count(*) OVER (PARTITION BY track_id, segment_idx) AS n,
         CASE WHEN part_end <= budget OR prev_lat IS NULL THEN lat ELSE {_CUT_LAT} END AS lat, CASE WHEN part_end <= budget OR prev_lat IS NULL THEN lon ELSE {_CUT_LON} END AS lon
  FROM (SELECT *, CASE WHEN leg_m > 0 THEN least(1, (budget - cum_start_m) / leg_m) ELSE 1 END AS t FROM budgets)
  WHERE budget > 0 AND part_start < budget AND (part_end <= budget OR prev_lat IS NULL OR (leg_m > 0 AND cum_start_m < budget)))"""


@query(
    "geojson_reveal",
    f"""WITH {sql.LEGS}, {REVEAL_SQL} SELECT track_id, count(DISTINCT segment_idx) AS n_lines, count(*) AS n_coordinates, {_SUMS}
      FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx) AS i FROM shown WHERE whole OR n > 1) GROUP BY track_id""",
)
def _reveal(points: DataFrame) -> DataFrame:
    return _geojson_digest(geojson.encode(points, 0.613))


FRACTIONS, SPACINGS = (0.0, 0.3, 0.613, 0.85, 1.0), (20.0, 200.0)
REVEALS_SQL = f"""
spacings AS (SELECT unnest([{", ".join(map(str, SPACINGS))}]::DOUBLE[]) AS spacing_m),
numbered AS (
  SELECT *, lead(point_idx) OVER s IS NULL AS last, min(cum_start_m) OVER (PARTITION BY track_id, segment_idx) AS part_start,
         max(cum_end_m) OVER (PARTITION BY track_id, segment_idx) AS part_end, max(cum_end_m) OVER (PARTITION BY track_id) AS total
  FROM axis, spacings WINDOW s AS (PARTITION BY spacing_m, track_id, segment_idx ORDER BY point_idx)),
greedy AS (
  SELECT spacing_m, track_id, segment_idx, list_reduce(list({{'acc': leg_m, 's': spacing_m, 'p': point_idx, 'out': [point_idx]}} ORDER BY point_idx), lambda a, x: {{
    'acc': CASE WHEN a.acc + x.acc >= x.s THEN 0 ELSE a.acc + x.acc END, 's': x.s, 'p': x.p,
    'out': CASE WHEN a.acc + x.acc >= x.s THEN list_append(a.out, x.p) ELSE a.out END}}).out AS kept
  FROM numbered GROUP BY spacing_m, track_id, segment_idx),
asked AS (
  SELECT n.*, list_contains(g.kept, n.point_idx) AS kept, fraction, total * fraction AS budget,
         CASE WHEN leg_m > 0 AND cum_start_m <= total * fraction AND total * fraction < cum_end_m THEN (total * fraction - cum_start_m) / leg_m END AS t
  FROM numbered n JOIN greedy g USING (spacing_m, track_id, segment_idx), (SELECT unnest([{", ".join(map(str, FRACTIONS))}]::DOUBLE[]) AS fraction)),
revealed AS (
  SELECT spacing_m, fraction, track_id, segment_idx, point_idx, CASE WHEN part_end > budget AND t IS NOT NULL THEN {_CUT_LAT} ELSE lat END AS lat,
         CASE WHEN part_end > budget AND t IS NOT NULL THEN {_CUT_LON} ELSE lon END AS lon
  FROM asked
  WHERE budget > 0 AND CASE WHEN part_end <= budget THEN kept OR last
    ELSE part_start < budget AND (t IS NOT NULL OR (kept AND cum_end_m <= budget AND (prev_lat IS NULL OR leg_m > 0))) END)"""


@query(
    "geojson_reveals",
    f"""WITH {sql.LEGS}, {REVEALS_SQL},
      placed AS (SELECT *, row_number() OVER (PARTITION BY spacing_m, fraction, track_id ORDER BY segment_idx, point_idx) AS i FROM revealed),
      summed AS (SELECT spacing_m, fraction, track_id, count(DISTINCT segment_idx) AS n_lines, count(*) AS n_coordinates, {_SUMS} FROM placed GROUP BY spacing_m, fraction, track_id)
      SELECT a.spacing_m, a.fraction, a.track_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_coordinates, 0) AS n_coordinates, coalesce(lon_sum, 0) AS lon_sum,
             coalesce(lat_sum, 0) AS lat_sum, coalesce(in_order, 0) AS in_order
      FROM (SELECT DISTINCT spacing_m, fraction, track_id FROM asked) a LEFT JOIN summed USING (spacing_m, fraction, track_id)""",
)
def _reveals(points: DataFrame) -> DataFrame:
    """Every track revealed at several fractions from one preparation, at two spacings of which the second thins."""
    each = F.explode(F.array(*map(F.lit, FRACTIONS)))
    requests = points.select("track_id").distinct().select("track_id", each.alias("fraction"))
    found = geojson.Reveal.of(points, *SPACINGS).encode(requests)
    return _geojson_digest(found, "fraction", "spacing_m")


@query(
    "geojson_thinned",
    f"""WITH {sql.LEGS}, {THIN_SQL} SELECT track_id, count(DISTINCT segment_idx) AS n_lines, count(*) AS n_coordinates, {_SUMS}
      FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY segment_idx, point_idx) AS i FROM thinned) GROUP BY track_id""",
)
def _thinned_feature(points: DataFrame) -> DataFrame:
    return _geojson_digest(geojson.encode_thinned(points, 1.0, 200.0))


_PAIRS = f"""
pairs AS (
  SELECT track_id, segment_idx, point_idx, lat, lon, ele, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(ele) OVER w AS p_ele
  FROM thinned WINDOW w AS (PARTITION BY track_id, segment_idx ORDER BY point_idx)),
{sql.inverse('pairs', 'sized', 'p_lat', 'p_lon', 'lat', 'lon')},
graded AS (SELECT *, round(CASE WHEN distance >= 100 THEN (ele - p_ele) / distance * 100 END, 9) AS grade FROM sized WHERE p_lat IS NOT NULL)"""


@query(
    "geojson_gradients",
    f"""WITH {sql.LEGS}, {THIN_SQL}, {_PAIRS} SELECT track_id, segment_idx, point_idx, {sql.band('grade')} AS band, {_case(sql.band('grade'), {b[0]: b[2] for b in sc.BANDS})} AS color,
      round_even(p_lon, 6) AS from_lon, round_even(p_lat, 6) AS from_lat, round_even(lon, 6) AS to_lon, round_even(lat, 6) AS to_lat FROM graded""",
)
def _gradients(points: DataFrame) -> DataFrame:
    """The features read back from their texts."""
    shape = "struct<properties:struct<band:string,color:string>,geometry:struct<coordinates:array<array<double>>>>"
    found = geojson.gradient_features(points, 200.0).select("track_id", "segment_idx", "point_idx", F.from_json("geojson", shape).alias("f"))
    at = lambda i, k: F.col("f.geometry.coordinates")[i][k]
    return found.select(
        "track_id", "segment_idx", "point_idx", "f.properties.band", "f.properties.color",
        at(0, 0).alias("from_lon"), at(0, 1).alias("from_lat"), at(1, 0).alias("to_lon"), at(1, 1).alias("to_lat"),
    )


def _waypoints(points: DataFrame) -> DataFrame:
    """The first points of segments as waypoints; every third has no name."""
    name = F.when(F.col("segment_idx") % 3 != 0, F.concat(F.lit("stop "), F.col("segment_idx").cast("string")))
    return points.filter("point_idx = 0").select("track_id", F.col("segment_idx").alias("wpt_idx"), name.alias("name"), "lat", "lon", "ele", "time_ms")


@query(
    "geojson_waypoints",
    f"""WITH {sql.POINTS} SELECT track_id, count(*) AS n, string_agg(CASE WHEN segment_idx % 3 <> 0 THEN 'stop ' || segment_idx ELSE CAST(segment_idx + 1 AS VARCHAR) END, ',' ORDER BY segment_idx) AS labels
      FROM points WHERE point_idx = 0 GROUP BY track_id""",
)
def _waypoint_features(points: DataFrame) -> DataFrame:
    found = geojson.encode_waypoints(_waypoints(points))
    parts = F.from_json(F.get_json_object("geojson", "$.features"), "array<struct<properties:struct<index:int,label:string>>>")
    return found.withColumn("f", parts).select(
        "track_id", F.size("f").cast("long").alias("n"), F.array_join(F.transform("f", lambda x: x["properties"]["label"]), ",").alias("labels")
    )


# Flyover.


@query("flyover_frames")
def _frames(points: DataFrame) -> DataFrame:
    return rounded(flyover.frames(points, 2000), 6)


@query(
    "flyover_durations",
    f"""WITH {sql.LEGS}, {_STRETCHES} SELECT track_id, CAST(greatest(6000, least(70000, trunc(flight / 1000 * 0.8 * 1000))) AS BIGINT) AS travel_ms FROM totals""",
)
def _durations(points: DataFrame) -> DataFrame:
    totals = sampling.stretches(points).groupBy("track_id").agg(F.max("total_flight_m").alias("m"))
    return totals.select("track_id", flyover.travel_ms(F.col("m"), flyover.FlyoverOptions()).alias("travel_ms"))


# Files.

_ISO = "strftime(make_timestamp(time_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN time_ms % 1000 = 0 THEN 'Z' ELSE printf('.%03dZ', time_ms % 1000) END"
GPX_SQL = f"""WITH {sql.POINTS},
bodies AS (
  SELECT track_id, segment_idx, '    <trkseg>' || chr(10) || string_agg(printf('      <trkpt lat="%.7f" lon="%.7f">', lat, lon) || chr(10)
    || CASE WHEN ele IS NULL THEN '' ELSE '        <ele>' || CAST(round(CAST(CAST(ele AS VARCHAR) AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) || '</ele>' || chr(10) END
    || '        <time>' || {_ISO} || '</time>' || chr(10) || '      </trkpt>' || chr(10), '' ORDER BY point_idx) || '    </trkseg>' || chr(10) AS body
  FROM points GROUP BY track_id, segment_idx)
SELECT track_id, md5(string_agg(body, '' ORDER BY segment_idx)) AS segments_md5,
  md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
    || 'xsi:schemaLocation="http://www.topografix.com/GPX/1/1 http://www.topografix.com/GPX/1/1/gpx.xsd">' || chr(10)
    || '  <metadata>' || chr(10) || '    <name>Way &amp; ' || track_id || '</name>' || chr(10) || '    <desc>&lt;made&gt;</desc>' || chr(10) || '  </metadata>' || chr(10)
    || '  <trk>' || chr(10) || '    <name>Way &amp; ' || track_id || '</name>' || chr(10) || string_agg(body, '' ORDER BY segment_idx) || '  </trk>' || chr(10) || '</gpx>' || chr(10)) AS whole_md5
FROM bodies GROUP BY track_id"""


@query("gpx_write", GPX_SQL)
def _gpx_write(points: DataFrame) -> DataFrame:
    inner = F.regexp_extract("xml", r"(?s)</name>\n(    <trkseg>.*</trkseg>\n)  </trk>", 1)
    names = points.select("track_id").distinct().select("track_id", F.concat(F.lit("Way & "), "track_id").alias("name"), F.lit("<made>").alias("description"))
    return gpx.write_gpx(points, names).select("track_id", F.md5(inner).alias("segments_md5"), F.md5("xml").alias("whole_md5"))


def _gpx_texts(points: DataFrame) -> DataFrame:
    """A document a track in an old version with a prefix, capitals, a loose point, points that cannot be used, an empty
    segment and a route, as ISO-8859-1 bytes."""
    place = lambda tag: F.format_string(f"<g:{tag} lat='%.7f' lon='%.7f'/>", F.col("lat"), F.col("lon"))
    at = F.struct("point_idx", place("trkpt").alias("text"))
    first = points.filter("segment_idx = 0").groupBy("track_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["text"]), "<g:trkpt lat='91' lon='0'/><g:trkpt lon='5'/>").alias("inner"),
        F.min_by(place("TRKPT"), "point_idx").alias("loose"), F.max_by(place("rtept"), "point_idx").alias("route"),
    )
    text = F.concat(
        F.lit("<?xml version='1.0' encoding='ISO-8859-1'?><g:gpx version='1.0' xmlns:g='http://www.topografix.com/GPX/1/0'><g:rte>"), "route",
        F.lit("</g:rte><g:TRK><g:name> H\u00f6he "), "track_id", F.lit(" </g:name>"), "loose", F.lit("<g:trkseg>"), "inner", F.lit("</g:trkseg><g:trkseg/></g:TRK></g:gpx>"),
    )
    return first.select(F.col("track_id").alias("path"), F.encode(text, "ISO-8859-1").alias("content"))


@query(
    "gpx_documents",
    f"""WITH {sql.POINTS}, firsts AS (SELECT * FROM points WHERE segment_idx = 0)
      SELECT track_id, 'H\u00f6he ' || track_id AS name, 0::INTEGER AS segment_idx, point_idx, {r('lat', 'lon', places=7)} FROM firsts
      UNION ALL SELECT track_id, 'H\u00f6he ' || track_id, 1, 0, {r('lat', 'lon', places=7)} FROM firsts WHERE point_idx = 0
      UNION ALL SELECT track_id, 'H\u00f6he ' || track_id, 2, 0, round(arg_max(lat, point_idx), 7), round(arg_max(lon, point_idx), 7) FROM firsts GROUP BY track_id""",
)
def _gpx_documents(points: DataFrame) -> DataFrame:
    found = gpx.read_gpx(_gpx_texts(points))
    named = found["points"].join(found["documents"].select("track_id", "name"), "track_id")
    return rounded(named.select("track_id", "name", "segment_idx", "point_idx", "lat", "lon"), 7)


@query(
    "gpx_round_trip",
    f"WITH {sql.POINTS} SELECT track_id, segment_idx, point_idx, {r('lat', 'lon', places=7)}, round(ele, 2) AS ele, time_ms FROM points",
)
def _round_trip(points: DataFrame) -> DataFrame:
    files = gpx.write_gpx(points).select(F.col("track_id").alias("path"), "xml")
    return rounded(gpx.read_gpx(files)["points"].drop("hacc_m"), 7)


@query(
    "route_catalog",
    f"""{WITH_STATS} SELECT track_id AS id, 'Route ' || track_id AS name, CAST(track_id AS BIGINT) * 1000 AS created_at_ms, {r('distance_m', 'gain_m', 'loss_m')}, point_count,
      {sql.difficulty('distance_m', 'gain_m')} AS difficulty, round(walking_s, 4) AS walking_s FROM stats""",
)
def _catalog(points: DataFrame) -> DataFrame:
    names = F.concat(F.lit(" Route "), F.col("track_id"), F.lit(" "))
    return rounded(catalog.listed(catalog.summaries(points, names, F.col("track_id").cast("long") * 1000)))


# Scalars over the points and over lineitem.

_MPD_LAT = "(111132.92 - 559.82 * cos(2 * radians({x})) + 1.175 * cos(4 * radians({x})) - 0.0023 * cos(6 * radians({x})))"
_MPD_LON = "(111412.84 * cos(radians({x})) - 93.5 * cos(3 * radians({x})) + 0.118 * cos(5 * radians({x})))"


@query(
    "leg_geodesy",
    f"""WITH {sql.LEGS}, h AS (SELECT *, (lat + prev_lat) / 2 AS mid FROM axis WHERE prev_lat IS NOT NULL)
      SELECT track_id, segment_idx, point_idx,
        round(2 * 6371008.8 * asin(least(1, sqrt(power(sin(radians(lat - prev_lat) / 2), 2) + cos(radians(prev_lat)) * cos(radians(lat)) * power(sin(radians(lon - prev_lon) / 2), 2)))), 4) AS sphere_m,
        round(sqrt(power((lon - prev_lon) * {_MPD_LON.format(x='mid')}, 2) + power((lat - prev_lat) * {_MPD_LAT.format(x='mid')}, 2)), 4) AS local_m,
        round(lat, 6) AS back_lat, round(lon, 6) AS back_lon FROM h""",
)
def _geodesy(points: DataFrame) -> DataFrame:
    """Sphere and plane beside the ellipsoid, and the direct problem leading back to where each leg ends."""
    found = tracks.legs(points)
    ends = [F.col(c) for c in ("prev_lat", "prev_lon", "lat", "lon")]
    back = geo.destination(F.col("prev_lat"), F.col("prev_lon"), F.col("bearing"), F.col("leg_m"))
    shown = found.select(
        "track_id", "segment_idx", "point_idx", F.round(geo.haversine(*ends), 4).alias("sphere_m"), F.round(geo.local_distance(*ends), 4).alias("local_m"), back.alias("b")
    )
    return shown.select("track_id", "segment_idx", "point_idx", "sphere_m", "local_m", F.round("b.lat", 6).alias("back_lat"), F.round("b.lon", 6).alias("back_lon"))


_DEVIATION = f"""
triples AS (
  SELECT track_id, segment_idx, point_idx, lat AS c_lat, lon AS c_lon, lag(lat) OVER w AS a_lat, lag(lon) OVER w AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon
  FROM points WINDOW w AS (PARTITION BY track_id, segment_idx ORDER BY point_idx)),
planes AS (SELECT *, (a_lat + b_lat + c_lat) / 3 AS mid FROM triples WHERE a_lat IS NOT NULL AND b_lat IS NOT NULL),
metric AS (
  SELECT *, (b_lon - a_lon) * {_MPD_LON.format(x='mid')} AS qx, (b_lat - a_lat) * {_MPD_LAT.format(x='mid')} AS qy,
         (c_lon - a_lon) * {_MPD_LON.format(x='mid')} AS px, (c_lat - a_lat) * {_MPD_LAT.format(x='mid')} AS py FROM planes),
along AS (SELECT *, CASE WHEN qx * qx + qy * qy = 0 THEN 0 ELSE greatest(0, least(1, (px * qx + py * qy) / (qx * qx + qy * qy))) END AS t FROM metric)"""


@query(
    "point_deviations",
    f"""WITH {sql.POINTS}, {_DEVIATION} SELECT track_id, segment_idx, point_idx, round(sqrt(power(px - qx * t, 2) + power(py - qy * t, 2)), 4) AS metres, round(t, 6) AS fraction FROM along""",
)
def _deviations(points: DataFrame) -> DataFrame:
    """How far each point lies from the line between its neighbours."""
    order = tracks.in_segment()
    around = points.select("*", *(f(c).over(order).alias(f"{k}_{c}") for k, f in (("a", F.lag), ("b", F.lead)) for c in ("lat", "lon")))
    off = geo.local_deviation(*((F.col(f"{k}lat"), F.col(f"{k}lon")) for k in ("a_", "b_", "")))
    found = around.filter("a_lat is not null and b_lat is not null").select("track_id", "segment_idx", "point_idx", off.alias("d"))
    return found.select("track_id", "segment_idx", "point_idx", F.round("d.metres", 4).alias("metres"), F.round("d.fraction", 6).alias("fraction"))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and small rules of the interface."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    grade, part = quantity * 0.73 - 17.31, F.col("l_discount").cast("double") * 10
    millis = F.lit(1_704_067_200_000) + (F.col("l_orderkey") * 7919 % 31_536_000) * 1000
    return line.select(
        "l_orderkey", "l_linenumber",
        sc.format_gradient(grade).alias("gradient"),
        sc.band_label(sc.gradient_band(grade)).alias("band"),
        sc.difficulty_label(sc.difficulty(price, quantity * 10)).alias("difficulty"),
        sc.format_clock(millis).alias("clock"), sc.format_date(millis).alias("day"),
        F.round(geo.normalize_longitude_delta(price / 50.0 - 900.0), 6).alias("delta"),
        prof.index_at(part, F.lit(239)).alias("chart_idx"),
        F.round(flyover.reveal_step(F.col("l_orderkey") * 11), 9).alias("step"),
        flyover.playback_start(F.col("l_linenumber") == 1, F.col("l_orderkey"), F.lit(900)).alias("starts_at"),
    )


QUERIES["label_forms"] = _forms


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    metres, turn = F.col("l_extendedprice").cast("double"), F.col("l_extendedprice").cast("double") / 50.0 - 900.0
    grade, t = (F.col("l_quantity").cast("double") - 25.0) / 60.0, F.col("l_discount").cast("double") * 10
    quarter = F.col("l_quantity").cast("double") * 0.25
    return line.select(
        "l_orderkey", "l_linenumber",
        F.round(sc.tobler_kmh(grade), 6).alias("kmh"),
        F.round(sc.hiking_seconds(metres, grade * metres), 4).alias("seconds"),
        sc.gradient_band(grade * 100.0).alias("band"),
        sc.difficulty(metres, F.col("l_quantity").cast("double") * 10).alias("difficulty"),
        F.round(geo.normalize_degrees(turn), 6).alias("degrees"),
        F.round(geo.normalize_longitude(turn), 6).alias("longitude"),
        F.round(sc.lerp_angle(F.lit(350.0), turn, t), 6).alias("angle"),
        F.round(sc.ease_out_cubic(t), 6).alias("ease_out"),
        F.round(sc.ease_in_out_cubic(t), 6).alias("ease_in_out"),
        F.round(sc.catmull_rom(F.lit(0.0), metres, turn, F.lit(1.0), t), 8).alias("spline"),
        F.round(sc.pseudo_random(F.lit(1.0), quarter), 4).alias("random"),
        sc.format_duration(metres).alias("duration"),
    )


QUERIES["scalar_functions"] = _lines
_P, _G, _TURN, _T = "l_extendedprice::DOUBLE", "((l_quantity::DOUBLE - 25.0) / 60.0)", "(l_extendedprice::DOUBLE / 50.0 - 900.0)", "(l_discount::DOUBLE * 10)"
_MOD = "({x} - 360 * floor({x} / 360))"
_DELTA = f"(CASE WHEN ({_TURN} - 350) % 360 > 180 THEN ({_TURN} - 350) % 360 - 360 WHEN ({_TURN} - 350) % 360 <= -180 THEN ({_TURN} - 350) % 360 + 360 ELSE ({_TURN} - 350) % 360 END)"
_ANGLE = _MOD.format(x=f"(350 + {_DELTA} * least(1, greatest(0, {_T})))")
_WAVE = "(sin(1.0::DOUBLE * 12.9898::DOUBLE + l_quantity::DOUBLE * 0.25::DOUBLE * 78.233::DOUBLE) * 43758.5453::DOUBLE)"
ORACLE_SQL["scalar_functions"] = f"""SELECT l_orderkey, l_linenumber, round(greatest(0.05, 6 * exp(-3.5 * abs({_G} + 0.05))), 6) AS kmh,
  round({sql.tobler(_P, f'({_G} * {_P})')}, 4) AS seconds, {sql.band(f'({_G} * 100.0::DOUBLE)')} AS band, {sql.difficulty(_P, '(l_quantity::DOUBLE * 10)')} AS difficulty,
  round({_MOD.format(x=_TURN)}, 6) AS degrees,
  round(CASE WHEN {_TURN} > -180 AND {_TURN} <= 180 THEN {_TURN} ELSE 180 - {_MOD.format(x=f'(180 - {_TURN})')} END, 6) AS longitude,
  round({_ANGLE}, 6) AS angle, round(1 - power(1 - least(1, greatest(0, {_T})), 3), 6) AS ease_out,
  round(CASE WHEN {_T} < 0.5 THEN 4 * power(greatest(0, {_T}), 3) ELSE 1 - power(2 - 2 * least(1, {_T}), 3) / 2 END, 6) AS ease_in_out,
  round(0.5 * (2 * {_P} + {_TURN} * {_T} + (-5 * {_P} + 4 * {_TURN} - 1) * {_T} * {_T} + (3 * {_P} - 3 * {_TURN} + 1) * {_T} * {_T} * {_T}), 8) AS spline,
  round({_WAVE} - floor({_WAVE}), 4) AS random,
  CASE WHEN {_P} >= 3600 THEN CAST(floor({_P} / 3600) AS BIGINT) || 'h ' || CAST(floor({_P} / 60) AS BIGINT) % 60 || 'm' ELSE CAST(floor({_P} / 60) AS BIGINT) || 'm' END AS duration
  FROM lineitem"""


_GRADE, _MS = "(l_quantity::DOUBLE * 0.73::DOUBLE - 17.31::DOUBLE)", "make_timestamp((1704067200000 + (l_orderkey * 7919 % 31536000) * 1000) * 1000)"
_LEVEL = sql.difficulty(_P, "(l_quantity::DOUBLE * 10)")
ORACLE_SQL["label_forms"] = f"""SELECT l_orderkey, l_linenumber, printf('%+.0f%%', {_GRADE}) AS gradient, {_case(sql.band(_GRADE), {b[0]: b[1] for b in sc.BANDS})} AS band,
  upper({_LEVEL}[1]) || lower({_LEVEL}[2:]) AS difficulty, strftime({_MS}, '%H:%M') AS clock, strftime({_MS}, '%-d %b %Y') AS day,
  round(CASE WHEN {_TURN} BETWEEN -180 AND 180 THEN {_TURN} ELSE 180 - {_MOD.format(x=f'(180 - {_TURN})')} END, 6) AS delta,
  CAST(greatest(0, least(239, floor({_T} * 239 + 0.5::DOUBLE))) AS INTEGER) AS chart_idx,
  round(CASE WHEN l_orderkey * 11 > 50000 THEN 0.02::DOUBLE WHEN l_orderkey * 11 > 10000 THEN 0.01::DOUBLE ELSE 1 / 300::DOUBLE END, 9) AS step,
  CAST(CASE WHEN l_linenumber = 1 OR l_orderkey >= 900 THEN 0 ELSE l_orderkey END AS BIGINT) AS starts_at FROM lineitem"""


@query(
    "format_labels",
    f"""{WITH_STATS} SELECT track_id,
      CASE WHEN distance_m < 1000 THEN printf('%.0f m', distance_m) ELSE printf('%.1f km', distance_m / 1000) END AS distance,
      CASE WHEN distance_m < 160.9344 THEN printf('%.0f ft', distance_m / 0.3048) ELSE printf('%.2f mi', distance_m / 1609.344) END AS distance_miles,
      printf('%.0f m', max_ele) AS height, printf('%.0f ft', gain_m / 0.3048) AS climbed,
      strftime(make_timestamp(start_ms // 1000 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN start_ms % 1000 = 0 THEN 'Z' ELSE printf('.%03dZ', start_ms % 1000) END AS started FROM stats""",
)
def _labels(points: DataFrame) -> DataFrame:
    """Short forms without thousands separators, which the two engines write differently."""
    stats = tracks.track_stats(points)
    plain = lambda c: F.replace(c, F.lit(","))
    return stats.select(
        "track_id", plain(sc.format_distance(F.col("distance_m"))).alias("distance"), plain(sc.format_distance(F.col("distance_m"), miles=True)).alias("distance_miles"),
        plain(sc.format_elevation(F.col("max_ele"))).alias("height"), plain(sc.format_elevation(F.col("gain_m"), feet=True)).alias("climbed"), sc.format_time(F.col("start_ms")).alias("started"),
    )


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in several forms and read back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    whole = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss")
    forms = F.array(sc.format_time(F.col("ms")), whole, F.concat(whole, F.lit("+01:00")), F.concat(whole, F.lit(" ")), F.lit("noon"), F.lit(""))
    read = events.select("event_id", F.get(forms, (F.col("event_id") % 6).cast("int")).alias("text"))
    return read.select("event_id", sc.parse_time(F.col("text")).alias("time_ms"))


QUERIES["parse_times"] = _times
ORACLE_SQL["parse_times"] = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN ms WHEN 1 THEN ms // 1000 * 1000 WHEN 2 THEN ms // 1000 * 1000 - 3600000 WHEN 3 THEN ms // 1000 * 1000 END AS time_ms
  FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events)"""


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels decoded and tiles projected back and forth."""
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    argb = (F.col("o_orderkey") * 2654435 + F.col("o_custkey") * 97) % 16777216
    zoom = (F.col("o_orderkey") % 23).cast("int")
    lat, lon = F.col("o_custkey") % 170 - 85.0, (F.col("o_orderkey") % 3600) / 10.0 - 180.0
    tile, pixel = dem.tile_for(lat, lon, zoom), dem.pixel_within(lat, lon, zoom)
    back = dem.position_for(F.col("t.x"), F.col("t.y"), F.col("p.x"), F.col("p.y"), F.col("zoom"))
    metres = dem.height(argb.cast("int"))
    rows = keys.select("o_orderkey", F.round(metres, 6).alias("metres"), dem.is_plausible(metres).alias("plausible"), zoom.alias("zoom"), tile.alias("t"), pixel.alias("p"))
    return rows.withColumn("b", back).select(
        "o_orderkey", "metres", "plausible", dem.tiles_per_axis(F.col("zoom")).alias("per_axis"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.round("b.lat", 6).alias("lat"), F.round("b.lon", 6).alias("lon")
    )


QUERIES["terrain_scalars"] = _terrain
_ARGB = "((o_orderkey * 2654435 + o_custkey * 97) % 16777216)"
_HEIGHT = f"(({_ARGB} // 65536) * 256.0::DOUBLE + ({_ARGB} // 256) % 256 + ({_ARGB} % 256) / 256.0::DOUBLE - 32768)"
ORACLE_SQL["terrain_scalars"] = f"""SELECT o_orderkey, round({_HEIGHT}, 6) AS metres, {_HEIGHT} > -500 AND {_HEIGHT} < 9000 AS plausible, CAST(power(2, o_orderkey % 23) AS BIGINT) AS per_axis,
  CAST(floor((lon + 180) / 360 * power(2, o_orderkey % 23)) AS INTEGER) AS x, CAST(floor({_MERCATOR.format(lat='lat')} * power(2, o_orderkey % 23)) AS INTEGER) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon
  FROM (SELECT *, (o_custkey % 170 - 85)::DOUBLE AS lat, (o_orderkey % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon FROM orders)"""
