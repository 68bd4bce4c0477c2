"""Heights from terrain tiles: a table of 256 x 256 pixels whose colours encode metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import is_valid

# The tiles' width, the projection's limit, the zooms and tiles of a fill, and heights that can be true.
TILE, LATITUDE_LIMIT, MOST_ZOOM = 256, 85.05112877980659, 22
FINEST, COARSEST, MOST_TILES = 13, 8, 64
LOWEST, HIGHEST = -500.0, 9000.0


def height(argb: Column) -> Column:
    """Metres from a pixel: red * 256 + green + blue / 256 - 32768."""
    part = lambda shift: F.shiftright(argb, shift).bitwiseAND(F.lit(255))
    return part(16) * 256.0 + part(8) + part(0) / 256.0 - 32768.0


def is_plausible(metres: Column) -> Column:
    return F.coalesce((metres > LOWEST) & (metres < HIGHEST), F.lit(False))


def tiles_per_axis(zoom: Column) -> Column:
    """2 to the zoom; null for a zoom outside 0 to 22."""
    return F.when(zoom.between(0, MOST_ZOOM), F.pow(F.lit(2.0), zoom).cast("long"))


def world(lat: Column, lon: Column, zoom: Column) -> tuple[Column, Column]:
    """Web-mercator coordinates in tiles."""
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.greatest(F.lit(-LATITUDE_LIMIT), F.least(F.lit(LATITUDE_LIMIT), lat)))
    return (lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n


def tile_for(lat: Column, lon: Column, zoom: Column) -> Column:
    """Struct of x and y of the tile; longitude 180 lies in the tile past the last."""
    x, y = world(lat, lon, zoom)
    return F.struct(F.floor(x).cast("int").alias("x"), F.floor(y).cast("int").alias("y"))


def pixel_within(lat: Column, lon: Column, zoom: Column) -> Column:
    """Struct of fractional pixel x and y inside the tile."""
    x, y = world(lat, lon, zoom)
    return F.struct(((x - F.floor(x)) * TILE).alias("x"), ((y - F.floor(y)) * TILE).alias("y"))


def position_for(x: Column, y: Column, pixel_x: Column, pixel_y: Column, zoom: Column) -> Column:
    """Struct of lat and lon of a pixel of a tile."""
    n = F.pow(F.lit(2.0), zoom)
    lat = F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (y + pixel_y / TILE) / n))))
    return F.struct(lat.alias("lat"), ((x + pixel_x / TILE) / n * 360.0 - 180.0).alias("lon"))


def tiles_covering(points: DataFrame, zoom: Column) -> DataFrame:
    """The distinct tiles (track_id, zoom, x, y) of the valid points."""
    tile = tile_for(F.col("lat"), F.col("lon"), zoom)
    inside = points.filter(is_valid(F.col("lat"), F.col("lon")))
    return inside.select("track_id", zoom.cast("int").alias("zoom"), tile.alias("t")).select("track_id", "zoom", "t.*").distinct()


def sampled(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points (with lat, lon, zoom) with dem_ele: bilinear between four pixel centres, clamped at the tile's edge; null
    where the tile is missing or of another size, or a pixel is implausible.

    Only the four pixels are read from each tile; points meet tiles by (zoom, x, y), both dealt by it: tiles are too large to
    be sent to all.
    """
    lat, lon, zoom = F.col("lat"), F.col("lon"), F.col("zoom")
    placed = points.withColumns({"_t": tile_for(lat, lon, zoom), "_p": pixel_within(lat, lon, zoom)})
    whole = tiles.filter(F.size("pixels") == TILE * TILE).toDF("_zoom", "_x", "_y", "_pixels")
    same = (zoom == F.col("_zoom")) & (F.col("_t.x") == F.col("_x")) & (F.col("_t.y") == F.col("_y")) & is_valid(lat, lon)
    met = placed.join(whole.hint("merge"), same, "left")
    edge = lambda v: F.greatest(F.lit(0), F.least(F.lit(TILE - 1), v)).cast("int")
    cx, cy = F.col("_p.x") - 0.5, F.col("_p.y") - 0.5
    x0, y0 = F.floor(cx), F.floor(cy)
    at = lambda x, y: height(F.get("_pixels", edge(y) * TILE + edge(x)))
    met = met.withColumns({"_00": at(x0, y0), "_10": at(x0 + 1, y0), "_01": at(x0, y0 + 1), "_11": at(x0 + 1, y0 + 1)})
    fx, fy = cx - x0, cy - y0
    top = F.col("_00") + (F.col("_10") - F.col("_00")) * fx
    bottom = F.col("_01") + (F.col("_11") - F.col("_01")) * fx
    good = is_plausible(F.col("_00")) & is_plausible(F.col("_10")) & is_plausible(F.col("_01")) & is_plausible(F.col("_11"))
    return met.select(*points.columns, F.when(good, top + (bottom - top) * fy).alias("dem_ele"))


def fill_zooms(points: DataFrame, most_tiles: int = MOST_TILES) -> DataFrame:
    """track_id, zoom, tiles: the finest zoom at which the points without height need few enough tiles."""
    zooms = F.explode(F.sequence(F.lit(COARSEST), F.lit(FINEST))).alias("zoom")
    missing = points.filter(F.col("ele").isNull() & is_valid(F.col("lat"), F.col("lon"))).select("track_id", "lat", "lon", zooms)
    tile = tile_for(F.col("lat"), F.col("lon"), F.col("zoom"))
    needed = missing.groupBy("track_id", "zoom").agg(F.count_distinct(tile).alias("tiles")).filter(F.col("tiles") <= most_tiles)
    return needed.groupBy("track_id").agg(F.max("zoom").alias("zoom"), F.max_by("tiles", "zoom").alias("tiles"))


def fill(points: DataFrame, tiles: DataFrame, most_tiles: int = MOST_TILES) -> DataFrame:
    """points with missing heights taken from tiles, and filled: whether this one was."""
    zooms = fill_zooms(points, most_tiles).select("track_id", "zoom")
    known = points.filter("ele is not null").select(*points.columns, F.lit(False).alias("filled"))
    missing = points.filter("ele is null").join(zooms, "track_id", "left")
    got = sampled(missing, tiles).withColumn("filled", F.col("dem_ele").isNotNull()).withColumn("ele", F.col("dem_ele"))
    return known.unionByName(got.select(*points.columns, "filled"))


def fill_report(points: DataFrame, filled: DataFrame, most_tiles: int = MOST_TILES) -> DataFrame:
    """track_id, zoom, tiles, points_filled of the tracks to which the fill added something."""
    counts = filled.groupBy("track_id").agg(F.count_if("filled").alias("points_filled")).filter("points_filled > 0")
    return fill_zooms(points, most_tiles).join(counts, "track_id")
