"""Positions at distances along tracks: as-of matches without a join.

Stretches (legs, and on the flight axis the gaps between recordings) and requests of a track are ordered together by
distance; a request takes the last stretch before it.  One window by track, whatever the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import interpolate, inverse
from .tracks import in_track, located


def stretches(points: DataFrame) -> DataFrame:
    """What can be asked for: a row for each leg and gap, with its start on both axes.

    track_id, segment_idx, point_idx, kind ('leg', 'gap'), walk_m, flight_m, length_m, ends (lat, lon, ele) and
    bearing; total_walk_m and total_flight_m of the track.  A segment without length is its first point.
    """
    on_axis = located(points)
    before = ("lat", "lon", "ele")
    gaps = on_axis.select(
        "*",
        *(F.lag(c).over(in_track()).alias(f"last_{c}") for c in before),
        F.lag("segment_idx").over(in_track()).alias("last_segment"),
        F.lead("segment_idx").over(in_track()).alias("next_segment"),
        F.sum("leg_m").over(Window.partitionBy("track_id", "segment_idx")).alias("segment_m"),
    )
    opens = F.col("prev_lat").isNull() & F.col("last_segment").isNotNull()
    gaps = gaps.withColumn("_gap", F.when(opens, inverse("last_lat", "last_lon", "lat", "lon")))
    gaps = gaps.withColumn("gap_m", F.coalesce("_gap.distance", F.lit(0.0)))
    flown = gaps.withColumn("gaps_m", F.sum("gap_m").over(in_track()))
    flown = flown.withColumn("gaps_before_m", F.coalesce(F.lag("gaps_m").over(in_track()), F.lit(0.0)))
    whole = Window.partitionBy("track_id")
    flown = flown.withColumns(
        {"total_walk_m": F.max("cum_end_m").over(whole), "total_flight_m": F.max(F.col("cum_end_m") + F.col("gaps_m")).over(whole)}
    )

    def row(kind: str, walk: Column, flight: Column, length: Column, start: tuple[Column, ...], bearing: Column, segment: Column) -> Column:
        end = tuple(F.col(c) for c in before)
        fields = {"kind": F.lit(kind), "segment_idx": segment, "walk_m": walk, "flight_m": flight, "length_m": length}
        fields |= {f"from_{c}": x for c, x in zip(before, start, strict=True)} | {f"to_{c}": x for c, x in zip(before, end, strict=True)}
        return F.struct(*(x.alias(k) for k, x in (fields | {"bearing": bearing}).items()))

    previous = tuple(F.col(f"prev_{c}") for c in before)
    last = tuple(F.col(f"last_{c}") for c in before)
    here = tuple(F.col(c) for c in before)
    walk, gaps_m = F.col("cum_start_m"), F.col("gaps_m")
    leg = row("leg", walk, walk + gaps_m, F.col("leg_m"), previous, F.col("bearing"), F.col("segment_idx"))
    still = row("leg", walk, walk + gaps_m, F.lit(0.0), here, F.lit(0.0), F.col("segment_idx"))
    gap = row("gap", walk, walk + F.col("gaps_before_m"), F.col("gap_m"), last, F.col("_gap.initial_bearing"), F.col("last_segment"))
    moves, first = F.col("segment_m") > 0, F.col("prev_lat").isNull()
    rows = F.array_compact(F.array(F.when(opens, gap), F.when(~first & moves, leg), F.when(first & ~moves, still)))
    return flown.select("track_id", "point_idx", "total_walk_m", "total_flight_m", F.explode(rows).alias("s")).select(
        "track_id", "point_idx", "total_walk_m", "total_flight_m", "s.*"
    )


def sample(track_stretches: DataFrame, requests: DataFrame, axis: str = "walk") -> DataFrame:
    """requests (track_id, distance_m; other columns stay) with lat, lon, ele, walked_m, segment_idx and bearing.

    axis: ``walk``, or ``flight``, which crosses gaps in a straight line while the walked distance rests.  Distances
    are clamped to the track; requests of unknown tracks get nulls.
    """
    if axis not in ("walk", "flight"):
        raise ValueError(f"unknown axis {axis!r}")
    kept = [c for c in requests.columns if c not in ("track_id", "distance_m")]
    usable = track_stretches.filter("kind = 'leg'") if axis == "walk" else track_stretches
    total = f"total_{axis}_m"
    stretch = F.struct(*(c for c in usable.columns if c not in ("track_id", "point_idx"))).alias("s")
    # At one distance: a segment's legs before the gap after it, then the next segment, then requests.
    order_in = F.when(F.col("kind") == "gap", F.col("segment_idx") + 0.5).otherwise(F.col("segment_idx").cast("double"))
    known = usable.select(
        "track_id", F.col(f"{axis}_m").alias("at"), order_in.alias("o1"), "point_idx", stretch, F.lit(None).alias("r"), F.lit(None).cast("double").alias("asked")
    )
    asked = requests.select(
        "track_id", F.greatest(F.lit(0.0), F.col("distance_m")).alias("at"), F.lit(float("inf")).alias("o1"), F.lit(0).alias("point_idx"),
        F.lit(None).cast(known.schema["s"].dataType).alias("s"), F.struct(F.lit(True).alias("_asked"), *kept).alias("r"), F.col("distance_m").cast("double").alias("asked"),
    )
    known = known.withColumn("r", F.lit(None).cast(asked.schema["r"].dataType))
    # A request past the end is the same as one at the end.
    order = Window.partitionBy("track_id").orderBy("at", "o1", "point_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = known.unionByName(asked).withColumn("s", F.last("s", True).over(order)).filter("r is not null")
    d = F.least(F.greatest(F.lit(0.0), F.col("asked")), F.col(f"s.{total}"))
    along = F.when(F.col("s.length_m") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - F.col(f"s.{axis}_m")) / F.nullif("s.length_m", F.lit(0.0))))).otherwise(0.0)
    place = interpolate(*(F.col(f"s.{c}") for c in ("from_lat", "from_lon", "to_lat", "to_lon")), along)
    height = F.coalesce(F.col("s.from_ele") + (F.col("s.to_ele") - F.col("s.from_ele")) * along, F.col("s.from_ele"), F.col("s.to_ele"))
    walked = F.when(F.col("s.kind") == "gap", F.col("s.walk_m")).otherwise(F.least(F.col("s.total_walk_m"), F.col("s.walk_m") + (d - F.col(f"s.{axis}_m"))))
    return found.withColumn("_p", place).select(
        "track_id", F.col("asked").alias("distance_m"), *(F.col(f"r.{c}").alias(c) for c in kept), F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"),
        height.alias("ele"), walked.alias("walked_m"), F.col("s.segment_idx").alias("segment_idx"), F.coalesce("s.bearing", F.lit(0.0)).alias("bearing"),
    )


def sample_fractions(track_stretches: DataFrame, requests: DataFrame) -> DataFrame:
    """sample() for requests (track_id, fraction) of the walking distance."""
    totals = track_stretches.groupBy("track_id").agg(F.max("total_walk_m").alias("_total"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraction")))
    return sample(track_stretches, requests.join(totals, "track_id").withColumn("distance_m", share * F.col("_total")).drop("_total"))
