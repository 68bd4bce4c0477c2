"""Where to look to see a whole track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import distance

#: The width in kilometres that zoom 0 shows, the range of zooms, and the tilt.
ZOOM_BASE, LEAST_ZOOM, MOST_ZOOM, TILT = 60_000.0, 3.0, 15.0, 60.0


def _direction() -> dict[str, Column]:
    """The unit vector of a position."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}


def _position() -> tuple[Column, Column]:
    """lat and lon of the direction x, y, z."""
    return F.degrees(F.atan2("z", F.hypot("x", "y"))), F.degrees(F.atan2("y", "x"))


def centroids(points: DataFrame) -> DataFrame:
    """track_id, lat, lon of the mean direction of the points."""
    means = points.groupBy("track_id").agg(*(F.avg(v).alias(k) for k, v in _direction().items()))
    lat, lon = _position()
    return means.select("track_id", lat.alias("lat"), lon.alias("lon"))


def zoom_for(diagonal_km: Column) -> Column:
    zoom = F.log2(ZOOM_BASE / F.nullif(diagonal_km, F.lit(0.0)))
    return F.when(diagonal_km <= 0, F.lit(MOST_ZOOM)).otherwise(F.greatest(F.lit(LEAST_ZOOM), F.least(F.lit(MOST_ZOOM), zoom)))


def cameras(points: DataFrame) -> DataFrame:
    """track_id, lat, lon, diagonal_km, zoom, tilt, bearing: a view of each track from above its centroid.

    Points are dealt by track once; the centroid is a window over them and the reach an aggregate where they lie.
    """
    track = Window.partitionBy("track_id")
    around = points.repartition("track_id").select("track_id", "lat", "lon", *(F.avg(v).over(track).alias(k) for k, v in _direction().items()))
    lat, lon = _position()
    far = around.withColumns({"_lat": lat, "_lon": lon}).withColumn("_d", distance("_lat", "_lon", "lat", "lon"))
    sums = far.groupBy("track_id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).agg((2 * F.max("_d") / 1000.0).alias("diagonal_km"))
    return sums.select("*", zoom_for(F.col("diagonal_km")).alias("zoom"), F.lit(TILT).alias("tilt"), F.lit(0.0).alias("bearing"))
