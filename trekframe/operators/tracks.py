"""Legs of tracks and the figures of whole tracks.

Points are dealt by chunks of their segments once.  What runs through a track is found on two levels: inside chunks, and over
one row for each chunk.  So a track of any length is worked on by as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geodesy import inverse, is_valid
from ..functions.scalars import difficulty, finite, gradient_band, hiking_seconds
from .climb import folded, summaries


def in_segment() -> WindowSpec:
    """The points of a segment in order."""
    return Window.partitionBy("track_id", "segment_idx").orderBy("point_idx")


def in_track() -> WindowSpec:
    """The points of a track in order."""
    return Window.partitionBy("track_id").orderBy("segment_idx", "point_idx")


def valid_points(points: DataFrame) -> DataFrame:
    """Points whose position can be used."""
    return points.filter(is_valid(F.col("lat"), F.col("lon")))


#: Points of a segment that one task works on at a time.
CHUNK = 1 << 16
#: What a chunk of a segment is known by.
PART = ["track_id", "segment_idx", "_chunk"]


def in_chunk() -> WindowSpec:
    """The points of a chunk in order."""
    return Window.partitionBy(*PART).orderBy("point_idx")


def chunks_in_order() -> WindowSpec:
    """The chunks of a track in order; one row each."""
    return Window.partitionBy("track_id").orderBy("segment_idx", "_chunk")


def dealt(points: DataFrame, chunk_points: int | None = None) -> DataFrame:
    """points with _chunk, dealt by chunks."""
    return points.withColumn("_chunk", F.floor(F.col("point_idx") / (chunk_points or CHUNK)).cast("long")).repartition(*PART)


def on_axis(points: DataFrame, chunk_points: int | None = None) -> DataFrame:
    """located() of points dealt by chunks, with what they know of the whole: _chunk, total_m (length of the track), _last
    (whether the point is its segment's last), _opening (whether it is its track's first) and _later (in the chunks that
    follow, d and ele of the first point at which the track goes on).

    A scan on two levels: what runs through a track is taken from a table with a row for each chunk, and added to what the
    chunk itself finds.  So no task holds a track, and chunks of a track are worked on apart.
    """
    carried = ("lat", "lon", "ele", "time_ms")
    apart = dealt(points, chunk_points)
    inner = apart.withColumns({"_first": F.lag("point_idx").over(in_chunk()).isNull()} | {f"_{c}": F.lag(c).over(in_chunk()) for c in carried})
    inner = inner.withColumn("_leg", inverse(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    inner = inner.withColumn("_m", F.coalesce("_leg.distance", F.lit(0.0)))
    inner = inner.withColumn("_inside_m", F.coalesce(F.sum("_m").over(in_chunk().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))

    # One row for each chunk: its ends, its length, and the first point at which it goes on.
    place, goes_on = F.struct(*carried), F.when(F.col("_m") > 0, F.col("point_idx"))
    chunks = inner.groupBy(*PART).agg(
        F.min_by(place, "point_idx").alias("_start"), F.max_by(place, "point_idx").alias("_end"), F.max("point_idx").alias("_end_idx"), F.sum("_m").alias("_length"),
        F.min_by(F.struct((F.col("_inside_m") + F.col("_m")).alias("d"), "ele"), goes_on).alias("_entry"),
    )
    in_part = Window.partitionBy("track_id", "segment_idx").orderBy("_chunk")
    chunks = chunks.withColumns({"_before": F.lag("_end").over(in_part), "_ends_part": F.lead("_chunk").over(in_part).isNull()})
    chunks = chunks.withColumn("_link", inverse(F.col("_before.lat"), F.col("_before.lon"), F.col("_start.lat"), F.col("_start.lon")))
    chunks = chunks.withColumn("_link_m", F.coalesce("_link.distance", F.lit(0.0)))
    before, grown = chunks_in_order().rowsBetween(Window.unboundedPreceding, -1), F.col("_link_m") + F.col("_length")
    chunks = chunks.withColumns({
        "_before_m": F.coalesce(F.sum(grown).over(before), F.lit(0.0)), "total_m": F.sum(grown).over(Window.partitionBy("track_id")),
        "_opens_track": F.row_number().over(chunks_in_order()) == 1,
    })
    entered = F.when(F.col("_link_m") > 0, F.struct((F.col("_before_m") + F.col("_link_m")).alias("d"), F.col("_start.ele").alias("ele"))).when(
        F.col("_entry").isNotNull(), F.struct((F.col("_before_m") + F.col("_link_m") + F.col("_entry.d")).alias("d"), F.col("_entry.ele").alias("ele"))
    )
    backwards = Window.partitionBy("track_id").orderBy(F.desc("segment_idx"), F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_entered", entered).withColumn("_later", F.last("_entered", True).over(backwards))
    known = chunks.select(*PART, "_before", "_link", "_link_m", "_before_m", "total_m", "_opens_track", "_later", F.when(F.col("_ends_part"), F.col("_end_idx")).alias("_end_idx"))

    first, start = F.col("_first"), F.col("_before_m") + F.when(F.col("_first"), F.lit(0.0)).otherwise(F.col("_link_m") + F.col("_inside_m"))
    leg = F.when(first, F.col("_link_m")).otherwise(F.col("_m"))
    return inner.join(known, PART).select(
        *apart.columns, *(F.when(first, F.col(f"_before.{c}")).otherwise(F.col(f"_{c}")).alias(f"prev_{c}") for c in carried),
        leg.alias("leg_m"), F.when(first, F.col("_link.initial_bearing")).otherwise(F.col("_leg.initial_bearing")).alias("bearing"),
        start.alias("cum_start_m"), (start + leg).alias("cum_end_m"), "total_m",
        F.coalesce(F.col("point_idx") == F.col("_end_idx"), F.lit(False)).alias("_last"), (first & F.col("_opens_track")).alias("_opening"), "_later",
    )


def located(points: DataFrame, chunk_points: int | None = None) -> DataFrame:
    """points with the leg that arrives at each: prev_lat, prev_lon, prev_ele, prev_time_ms (null at a segment's
    start), leg_m (0 there), bearing, and cum_start_m, cum_end_m on the walking axis, which runs through a whole track
    and does not count the gaps between segments."""
    return on_axis(points, chunk_points).drop("_chunk", "total_m", "_last", "_opening", "_later")


def legs(points: DataFrame) -> DataFrame:
    """A row for each pair of neighbours in a segment."""
    return located(points).filter("prev_lat is not null")


def elevation_gain(points: DataFrame, threshold: float = 3.0, gap_reset: bool = True, chunk_points: int | None = None) -> DataFrame:
    """track_id, gain_m, loss_m; gap_reset: climbing is counted inside segments only, else a gap counts as a leg.

    The reference moves only when a height differs from it by more than the threshold; missing heights hold it.  Tracks
    without heights have neither gain nor loss.
    """
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    known = folded(summaries(dealt(points, chunk_points), PART, threshold), threshold, gap_reset)
    none = F.lit(0.0)
    return points.select("track_id").distinct().join(known, "track_id", "left").select(
        "track_id", F.coalesce("gain_m", none).alias("gain_m"), F.coalesce("loss_m", none).alias("loss_m")
    )


def track_stats(
    points: DataFrame, threshold: float = 3.0, moving_mps: float = 0.3, most_gap_ms: int = 60_000, gap_reset: bool = False
) -> DataFrame:
    """One row a track: counts, distance, climb, heights, times and speeds.

    The moving speed is the whole distance over the moving time; moving_ms is null unless some leg has a usable
    duration, elapsed_ms unless the last known time is after the first.
    """
    return _stats(points, located(points), threshold, moving_mps, most_gap_ms, gap_reset)


def _stats(points: DataFrame, found: DataFrame, threshold: float, moving_mps: float, most_gap_ms: int, gap_reset: bool, *more: Column) -> DataFrame:
    """found: located points; every figure but the climb is a sum or a bound, so chunks are summed before they meet."""
    took = F.col("time_ms") - F.col("prev_time_ms")
    usable = (took > 0) & (took <= most_gap_ms)
    moving = usable & (F.col("leg_m") / (took / 1000.0) >= moving_mps)
    at = F.when(F.col("time_ms").isNotNull(), F.struct("segment_idx", "point_idx"))
    height = finite(F.col("ele"))
    sums = found.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.sum("leg_m").alias("distance_m"),
        F.min(height).alias("min_ele"),
        F.max(height).alias("max_ele"),
        F.min_by("time_ms", at).alias("start_ms"),
        F.max_by("time_ms", at).alias("end_ms"),
        F.sum(F.when(moving, took).when(usable, F.lit(0))).alias("moving_ms"),
        *more,
    )
    known = folded(summaries(dealt(points), PART, threshold), threshold, gap_reset)
    sums = sums.join(known, "track_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("gain_m", "loss_m")})
    elapsed = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms"))
    speed = lambda ms: F.when(ms > 0, F.col("distance_m") / (ms / 1000.0))
    return sums.withColumn("elapsed_ms", elapsed).withColumns(
        {"average_mps": speed(F.col("elapsed_ms")), "moving_mps": speed(F.col("moving_ms"))}
    )


def route_analysis(points: DataFrame, threshold: float = 3.0, least_leg_m: float = 20.0) -> DataFrame:
    """track_stats with walking time, average and steepest gradients and difficulty: one aggregate over the legs."""
    found = located(points)
    rise = F.col("ele") - F.col("prev_ele")
    grade = F.when(F.col("leg_m") >= least_leg_m, rise / F.nullif("leg_m", F.lit(0.0)) * 100.0)
    stats = _stats(
        points, found, threshold, 0.3, 60_000, False,
        F.sum(hiking_seconds(F.col("leg_m"), rise)).alias("walking_s"),
        F.max(F.when(grade > 0, grade)).alias("steepest_climb_pct"),
        F.min(F.when(grade < 0, grade)).alias("steepest_descent_pct"),
    )
    average = F.when(F.col("min_ele").isNotNull() & (F.col("distance_m") > 0), (F.col("gain_m") - F.col("loss_m")) / F.nullif("distance_m", F.lit(0.0)) * 100.0)
    return stats.withColumns({"average_gradient_pct": average, "difficulty": difficulty(F.col("distance_m"), F.col("gain_m"))})


def band_fractions(samples: DataFrame) -> DataFrame:
    """track_id, band, fraction: the share of the profile's distance in each gradient band."""
    stretch = F.col("distance_m") - F.lag("distance_m").over(Window.partitionBy("track_id").orderBy("sample_idx"))
    weighed = samples.withColumn("_w", stretch).filter("_w > 0").withColumn("band", gradient_band(F.col("gradient_pct")))
    sums = weighed.groupBy("track_id", "band").agg(F.sum("_w").alias("_w"), F.min("sample_idx").alias("first_idx"))
    whole = F.sum("_w").over(Window.partitionBy("track_id"))
    return sums.select("track_id", "band", (F.col("_w") / whole).alias("fraction"), "first_idx")


def dominant_bands(fractions: DataFrame) -> DataFrame:
    """track_id, band of the largest share (of equal ones the first met) and gradient_distribution as a map."""
    largest = F.struct(F.round("fraction", 12), -F.col("first_idx"))
    return fractions.groupBy("track_id").agg(
        F.max_by("band", largest).alias("dominant_band"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "fraction")))).alias("gradient_distribution"),
    )
