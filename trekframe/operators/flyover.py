"""Camera timelines: where to look from while a track is flown along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import interpolate
from ..functions.scalars import ease_in_out_cubic, ease_out_cubic, lerp, lerp_angle, shortest_delta
from .sampling import sample, stretches

#: Fixed value: metres between two bearings of a track's bearing profile.
BEARING_STEP_M = 25.0


@dataclass(frozen=True)
class FlyoverOptions:
    """Times in milliseconds, angles in degrees; the defaults are fixed values."""

    intro_ms: int = 3000
    outro_ms: int = 3500
    seconds_per_km: float = 0.8
    least_travel_ms: int = 6000
    most_travel_ms: int = 70_000
    travel_tilt: float = 60.0
    intro_tilt: float = 38.0
    outro_tilt: float = 30.0
    overview_zoom: float = 11.0
    travel_zoom: float = 13.5
    outro_zoom: float = 10.5
    bearing_offset: float = 20.0
    look_ahead_m: float = 0.0
    bearing_window_m: float = 800.0
    intro_sweep: float = 70.0

    def __post_init__(self):
        signs = (self.intro_ms, self.outro_ms, self.seconds_per_km, self.look_ahead_m, self.bearing_window_m)
        if min(signs) < 0 or self.least_travel_ms <= 0 or self.most_travel_ms < self.least_travel_ms:
            raise ValueError("times, distances and paces must not be negative, and the travel times must be in order")


def travel_ms(flight_m: Column, options: FlyoverOptions) -> Column:
    paced = (flight_m / 1000.0 * options.seconds_per_km * 1000.0).cast("long")
    return F.greatest(F.lit(options.least_travel_ms), F.least(F.lit(options.most_travel_ms), paced)).cast("long")


def _headed(found: DataFrame, options: FlyoverOptions) -> DataFrame:
    """Sampled frames (the fields of frame, with lat, lon, ele and walked_m) with the heading between the two steps of the
    bearing profile around each; found has the rows of frames and steps (those with an idx and no frame).

    Windows by track alone, no join.  Steps are most of the rows, so they carry nothing but their bearing through the sorts.
    """
    kind = F.col("idx").isNotNull()
    frame = F.when(~kind, F.struct("frame.*", "lat", "lon", "ele", "walked_m")).alias("frame")
    narrow = found.select("track_id", "distance_m", "idx", "bearing", kind.alias("_step"), frame)
    steps = Window.partitionBy("track_id", "_step").orderBy("idx")
    turn = F.coalesce(shortest_delta(F.lag("bearing").over(steps), F.col("bearing")), F.col("bearing"))
    unwrapped = narrow.withColumn("_turn", turn)
    unwrapped = unwrapped.withColumn("_heading", F.sum("_turn").over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    half = int(options.bearing_window_m / BEARING_STEP_M + 0.5)
    smooth = unwrapped.withColumn("_from", F.avg("_heading").over(steps.rowsBetween(-half, half)))
    smooth = smooth.withColumn("_to", F.lead("_from").over(steps))
    smooth = smooth.select("track_id", "distance_m", "_step", "frame", F.when(F.col("_step"), F.struct("idx", "_from", "_to")).alias("_met"))
    before = Window.partitionBy("track_id").orderBy("distance_m", F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    placed = smooth.withColumn("_met", F.last("_met", True).over(before)).filter(~F.col("_step"))
    part = F.col("distance_m") / BEARING_STEP_M - F.col("_met.idx")
    heading = F.when(F.col("_met._to").isNull(), F.col("_met._from")).otherwise(lerp(F.col("_met._from"), F.col("_met._to"), part))
    return placed.select("track_id", "distance_m", heading.alias("heading"), "frame.*")


def frames(points: DataFrame, step_ms: int = 1000, options: FlyoverOptions | None = None) -> DataFrame:
    """track_id, elapsed_ms, phase, camera (lat, lon, zoom, tilt, bearing), progress, revealed, walked_m, ele and position
    (here_lat, here_lon): a frame every step and one at the end."""
    o = options or FlyoverOptions()
    flown = stretches(points)
    totals = flown.groupBy("track_id").agg(F.max("total_flight_m").alias("flight_m"), F.max("total_walk_m").alias("walk_m"))
    timed = totals.withColumn("travel_ms", travel_ms(F.col("flight_m"), o))
    duration = F.col("travel_ms") + (o.intro_ms + o.outro_ms)
    # Frames (elapsed_ms) and the steps of the bearing profile (idx) are asked for together, so that stretches are sampled once.
    ticks = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col("duration_ms"), F.lit(step_ms).cast("long")), F.array("duration_ms")))
    steps = F.sequence(F.lit(0), F.ceil(F.col("flight_m") / BEARING_STEP_M).cast("int"))
    tick = lambda t: F.struct(t.alias("elapsed_ms"), F.lit(None).cast("int").alias("idx"))
    step = lambda k: F.struct(F.lit(None).cast("long").alias("elapsed_ms"), k.alias("idx"))
    clock = timed.withColumn("duration_ms", duration).withColumn("_w", F.explode(F.concat(F.transform(ticks, tick), F.transform(steps, step)))).select("*", "_w.*").drop("_w")
    travelled = (F.col("elapsed_ms") - o.intro_ms) / F.col("travel_ms")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), travelled))
    phase = F.when(F.col("elapsed_ms") < o.intro_ms, "Intro").when(F.col("elapsed_ms") < o.intro_ms + F.col("travel_ms"), "Travel").otherwise("Outro")
    way = F.when(F.col("idx").isNotNull(), F.col("idx") * F.lit(BEARING_STEP_M)).otherwise(share * F.col("flight_m"))
    frame = F.struct("elapsed_ms", phase.alias("phase"), "flight_m", "walk_m", "travel_ms", "duration_ms")
    asked = clock.select("track_id", way.alias("distance_m"), "idx", F.when(F.col("idx").isNull(), frame).alias("frame"))
    here = _headed(sample(flown, asked, "flight"), o).withColumnsRenamed({"lat": "here_lat", "lon": "here_lon"})
    ahead = here.withColumn("_at", F.col("distance_m")).withColumn("distance_m", F.col("_at") + o.look_ahead_m)
    if o.look_ahead_m > 0:
        seen = sample(flown, ahead.withColumnRenamed("ele", "here_ele").withColumnRenamed("walked_m", "here_walked_m"), "flight")
        seen = seen.drop("ele", "walked_m", "segment_idx", "bearing").withColumnsRenamed({"here_ele": "ele", "here_walked_m": "walked_m"})
    else:
        seen = ahead.withColumns({"lat": F.col("here_lat"), "lon": F.col("here_lon")})
    seen = seen.withColumn("distance_m", F.col("_at")).drop("_at")
    rows = seen.withColumn("_bearing", F.pmod(F.col("heading") + o.bearing_offset, F.lit(360.0)))
    intro = F.lit(1.0) if o.intro_ms == 0 else ease_out_cubic(F.col("elapsed_ms") / o.intro_ms)
    out = F.col("elapsed_ms") - o.intro_ms - F.col("travel_ms")
    outro = F.lit(1.0) if o.outro_ms == 0 else ease_in_out_cubic(out / o.outro_ms)
    is_intro, is_outro = F.col("phase") == "Intro", F.col("phase") == "Outro"
    by_phase = lambda a, b, c: F.when(is_intro, a).when(is_outro, c).otherwise(b)
    bearing = F.col("_bearing")
    opening = F.pmod(bearing - o.intro_sweep, F.lit(360.0))
    target = interpolate(F.col("here_lat"), F.col("here_lon"), F.col("lat"), F.col("lon"), by_phase(intro, F.lit(1.0), 1.0 - outro))
    zoom = by_phase(lerp(F.lit(o.overview_zoom), F.lit(o.travel_zoom), intro), F.lit(o.travel_zoom), lerp(F.lit(o.travel_zoom), F.lit(o.outro_zoom), outro))
    tilt = by_phase(lerp(F.lit(o.intro_tilt), F.lit(o.travel_tilt), intro), F.lit(o.travel_tilt), lerp(F.lit(o.travel_tilt), F.lit(o.outro_tilt), outro))
    walked = by_phase(F.lit(0.0), F.col("walked_m"), F.col("walk_m"))
    revealed = by_phase(F.lit(0.0), F.when(F.col("walk_m") > 0, F.least(F.lit(1.0), F.col("walked_m") / F.nullif("walk_m", F.lit(0.0)))).otherwise(1.0), F.lit(1.0))
    return rows.withColumn("_t", target).select(
        "track_id", "elapsed_ms", "phase", F.col("_t.lat").alias("lat"), F.col("_t.lon").alias("lon"), zoom.alias("zoom"), tilt.alias("tilt"),
        by_phase(lerp_angle(opening, bearing, intro), bearing, bearing).alias("bearing"),
        (F.col("elapsed_ms") / F.col("duration_ms")).alias("progress"), revealed.alias("revealed"), walked.alias("walked_m"), "ele", "here_lat", "here_lon",
    )


def reveal_step(point_count: Column) -> Column:
    """How coarsely a flight reveals its track."""
    return F.when(point_count > 50_000, 0.02).when(point_count > 10_000, 0.01).otherwise(1 / 300)


def playback_start(finished: Column, flight_ms: Column, duration_ms: Column) -> Column:
    return F.when(finished | (flight_ms >= duration_ms), F.lit(0).cast("long")).otherwise(flight_ms)
