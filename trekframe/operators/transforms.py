"""Tracks from tracks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import arc, direct_arrays, inverse_arrays, local_deviation, on_arc
from ..sources.tables import settled
from .thinning import spaced
from .tracks import PART, on_axis

POINT_COLUMNS = ["track_id", "segment_idx", "point_idx", "lat", "lon", "ele", "time_ms", "hacc_m"]


def reverse(points: DataFrame) -> DataFrame:
    """Every track from its end to its start.  Times of a segment whose points all have one are mirrored inside it
    (so a track of several segments then starts after it ends); others are left as they are."""
    whole, part = Window.partitionBy("track_id"), Window.partitionBy("track_id", "segment_idx")
    timed = F.count("time_ms").over(part) == F.count(F.lit(1)).over(part)
    ordered = part.orderBy("point_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mirrored = F.first("time_ms").over(ordered) + F.last("time_ms").over(ordered) - F.col("time_ms")
    return points.repartition("track_id").select(
        "track_id",
        (F.max("segment_idx").over(whole) - F.col("segment_idx")).cast("int").alias("segment_idx"),
        (F.max("point_idx").over(part) - F.col("point_idx")).cast("int").alias("point_idx"),
        "lat", "lon", "ele", F.when(timed, mirrored).otherwise(F.col("time_ms")).alias("time_ms"), "hacc_m",
    )


def merge(parts: DataFrame) -> DataFrame:
    """Points with part_idx, the order of the tracks that one track is put together from (all with its track_id):
    segments follow each other and are never joined."""
    order = Window.partitionBy("track_id").orderBy("part_idx", "segment_idx")
    return parts.withColumn("segment_idx", (F.dense_rank().over(order) - 1).cast("int")).select(*POINT_COLUMNS)


def densify(points: DataFrame, spacing_m: float = 25.0) -> DataFrame:
    """Points so close that no leg is longer than the spacing.  Heights are linear where both ends have one; times and
    accuracy stay with a segment's first point only; legs without length vanish.

    A point is numbered by how many all points before it become, so what is shuffled and sorted are the given points.  These
    are dealt by chunks once more, and new ones are made last.
    """
    if spacing_m <= 0:
        raise ValueError("the spacing must be positive")
    first, legs = F.col("prev_lat").isNull(), F.col("leg_m") > 0
    steps = F.greatest(F.lit(1), F.ceil(F.col("leg_m") / spacing_m)).cast("int")
    before = Window.partitionBy("track_id", "segment_idx").orderBy("point_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = on_axis(points).select(*PART, "point_idx", "lat", "lon", "ele", "time_ms", "hacc_m", "prev_lat", "prev_lon", "prev_ele", "leg_m", steps.alias("_n"))
    made = F.when(first, F.lit(1)).when(legs, F.col("_n")).otherwise(F.lit(0))
    rows = rows.withColumn("_before", F.coalesce(F.sum(made).over(before), F.lit(0))).repartition(*PART)
    rows = rows.withColumns({"_arc": arc(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")), "_first": first})
    numbers = F.when(first, F.array(F.lit(0))).when(legs, F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_k", F.explode(numbers))
    t = F.col("_k") / F.col("_n")
    only_first = lambda c: F.when(F.col("_first"), F.col(c))
    return rows.withColumn("_p", on_arc(F.col("_arc"), t)).select(
        "track_id", "segment_idx", (F.col("_before") + F.greatest(F.col("_k") - 1, F.lit(0))).cast("int").alias("point_idx"),
        F.when(F.col("_first"), F.col("lat")).otherwise(F.col("_p.lat")).alias("lat"),
        F.when(F.col("_first"), F.col("lon")).otherwise(F.col("_p.lon")).alias("lon"),
        F.when(F.col("_first"), F.col("ele")).otherwise(F.col("prev_ele") + (F.col("ele") - F.col("prev_ele")) * t).alias("ele"),
        only_first("time_ms").alias("time_ms"), only_first("hacc_m").alias("hacc_m"),
    )


def from_waypoints(waypoints: DataFrame, spacing_m: float = 25.0, closed: bool = False) -> DataFrame:
    """One densified segment through waypoints (track_id, wpt_idx, lat, lon, ele, time_ms); closed: back to the first."""
    points = waypoints.select(
        "track_id", F.lit(0).alias("segment_idx"), F.col("wpt_idx").alias("point_idx"), "lat", "lon", "ele", "time_ms", F.lit(None).cast("double").alias("hacc_m")
    )
    if closed:  # the last waypoint is followed by the first once more
        order = Window.partitionBy("track_id").orderBy("point_idx")
        last = F.lead("point_idx").over(order).isNull() & F.lag("point_idx").over(order).isNotNull()
        first = [F.first(c).over(order).alias(c) for c in ("lat", "lon", "ele")]
        back = F.struct((F.col("point_idx") + 1).alias("point_idx"), *first, F.lit(None).cast("long").alias("time_ms"))
        own = F.struct("point_idx", "lat", "lon", "ele", "time_ms")
        rows = points.select("track_id", "segment_idx", "hacc_m", own.alias("own"), F.when(last, back).alias("back"))
        rows = rows.select("track_id", "segment_idx", "hacc_m", F.explode(F.array_compact(F.array("own", "back"))).alias("p"))
        points = rows.select("track_id", "segment_idx", "p.*", "hacc_m")
    return densify(points, spacing_m)


def thin(points: DataFrame, spacing_m: float = 30.0) -> DataFrame:
    """Of every segment the first and last point and each at which the distance since the last kept one reaches the
    spacing; chunks of a segment are thinned apart (see thinning.py)."""
    if spacing_m <= 0:
        raise ValueError("the spacing must be positive")
    return spaced(points, spacing_m).filter("_kept or _last").select(*points.columns)


def _deviations(lat, lon, ele, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Metres aside and metres above or below of the points between a and b from the straight line."""
    inner = slice(a + 1, b)
    mid = (lat[a] + lat[b] + lat[inner]) / 3
    phi = np.radians(mid)
    north = 111132.92 - 559.82 * np.cos(2 * phi) + 1.175 * np.cos(4 * phi) - 0.0023 * np.cos(6 * phi)
    east = 111412.84 * np.cos(phi) - 93.5 * np.cos(3 * phi) + 0.118 * np.cos(5 * phi)
    turn = lambda d: np.where(np.abs(d) <= 180, d, (d + 180) % 360 - 180)
    bx, by = turn(lon[b] - lon[a]) * east, (lat[b] - lat[a]) * north
    px, py = turn(lon[inner] - lon[a]) * east, (lat[inner] - lat[a]) * north
    square = bx * bx + by * by
    along = np.clip(np.divide(px * bx + py * by, square, out=np.zeros_like(px), where=square > 0), 0, 1)
    aside = np.hypot(px - bx * along, py - by * along)
    return aside, np.nan_to_num(np.abs(ele[inner] - (ele[a] + (ele[b] - ele[a]) * along)))


def _kept(lat: np.ndarray, lon: np.ndarray, ele: np.ndarray, horizontal_m: float, vertical_m: float) -> np.ndarray:
    """Which points of a segment Douglas-Peucker keeps."""
    ratio = lambda d, most: d / most if most > 0 else np.where(d > 0, np.finfo(float).max, 0.0)
    keep = np.zeros(len(lat), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(lat) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        aside, above = _deviations(lat, lon, ele, a, b)
        score = np.maximum(ratio(aside, horizontal_m), ratio(above, vertical_m))
        worst = int(score.argmax())
        if score[worst] > 1:
            at = a + 1 + worst
            keep[at] = True
            todo += [(a, at), (at, b)]
    return keep


#: Points of a segment, or of an open stretch of one, that are simplified in one piece.
PIECE = 1 << 18
_SEGMENT = ["track_id", "segment_idx"]


def simplify(points: DataFrame, horizontal_m: float = 5.0, vertical_m: float = 3.0, piece_points: int | None = None) -> DataFrame:
    """Douglas-Peucker in three dimensions by segment: a point stays if it is further from the line than a tolerance,
    aside or in height (points without height: aside only).

    Segments of at most ``PIECE`` points flow by in order, one at a time.  Longer ones are cut first, in rounds: each open
    stretch takes the point furthest from its line, found by all tasks that have points of it, and becomes two, until
    no open stretch is longer.  A round is one job however many segments and stretches are open.
    """
    if horizontal_m < 0 or vertical_m < 0:
        raise ValueError("tolerances must not be negative")
    most = piece_points or PIECE
    long = settled(points.groupBy(*_SEGMENT).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most), "simplify-long")
    if long.isEmpty():
        return _pieces(points, _SEGMENT, horizontal_m, vertical_m)
    short = _pieces(points.join(long, _SEGMENT, "left_anti"), _SEGMENT, horizontal_m, vertical_m)
    kept = _cut_rounds(points.join(long, _SEGMENT, "left_semi"), horizontal_m, vertical_m, most)
    return short.unionByName(points.join(kept, [*_SEGMENT, "point_idx"], "left_semi"))


def _score(horizontal_m: float, vertical_m: float) -> Column:
    """How many tolerances a point (lat, lon, ele) lies off the line between the structs a and b."""
    found = local_deviation((F.col("a.lat"), F.col("a.lon")), (F.col("b.lat"), F.col("b.lon")), (F.col("lat"), F.col("lon")))
    above = F.abs(F.col("ele") - (F.col("a.ele") + (F.col("b.ele") - F.col("a.ele")) * found["fraction"]))
    above = F.coalesce(F.nanvl(above, F.lit(0.0)), F.lit(0.0))
    ratio = lambda d, most: d / most if most > 0 else F.when(d > 0, float(np.finfo(float).max)).otherwise(0.0)
    return F.greatest(ratio(found["metres"], horizontal_m), ratio(above, vertical_m))


def _cut_rounds(points: DataFrame, horizontal_m: float, vertical_m: float, most: int) -> DataFrame:
    """The columns of _SEGMENT and point_idx of the kept points of long segments."""
    place = F.struct("point_idx", "lat", "lon", "ele")
    ends = points.groupBy(*_SEGMENT).agg(F.min_by(place, "point_idx").alias("a"), F.max_by(place, "point_idx").alias("b"), F.count(F.lit(1)).alias("_n"))
    # Open stretches are few: each has more than so many points.  They are known by the point they start with.
    open_ = settled(ends.withColumn("_from", F.col("a.point_idx")), "simplify-open")
    inner = points.select(*_SEGMENT, "point_idx", "lat", "lon", "ele").join(F.broadcast(open_.select(*_SEGMENT, "_from", "a", "b")), _SEGMENT)
    inner = inner.filter("point_idx > a.point_idx and point_idx < b.point_idx").drop("a", "b")
    tables = [open_.select(*_SEGMENT, F.explode(F.array("a.point_idx", "b.point_idx")).alias("point_idx"))]
    keys = [*_SEGMENT, "_from"]
    while not open_.isEmpty():
        measured = inner.join(F.broadcast(open_.select(*keys, "a", "b")), keys).withColumn("_score", _score(horizontal_m, vertical_m))
        first_worst = F.struct("_score", -F.col("point_idx"))
        worst = measured.groupBy(*keys).agg(F.max_by(place, first_worst).alias("w"), F.max("_score").alias("_top")).filter("_top > 1")
        cuts = settled(open_.select(*keys, "a", "b").join(worst.select(*keys, "w"), keys), "simplify-cuts")
        found = cuts.select(*_SEGMENT, "w.point_idx")
        moved = inner.join(F.broadcast(cuts.select(*keys, "w")), keys).filter("point_idx <> w.point_idx")
        moved = moved.withColumn("_from", F.when(F.col("point_idx") > F.col("w.point_idx"), F.col("w.point_idx")).otherwise(F.col("_from"))).drop("w")
        inner = settled(moved, "simplify-inner")
        halves = F.explode(F.array(F.struct(F.col("a"), F.col("w").alias("b")), F.struct(F.col("w").alias("a"), F.col("b")))).alias("h")
        halves = cuts.select(*_SEGMENT, halves).select(*_SEGMENT, F.col("h.a.point_idx").alias("_from"), "h.a", "h.b")
        sizes = inner.groupBy(*keys).agg((F.count(F.lit(1)) + 2).alias("_n"))
        counted = settled(halves.join(sizes, keys), "simplify-halves")
        small = counted.filter(F.col("_n") <= most)
        edges = small.select(*keys, F.explode(F.array("a", "b")).alias("p")).select(*keys, "p.point_idx", "p.lat", "p.lon", "p.ele")
        whole = inner.join(small.select(*keys), keys, "left_semi").select(*keys, "point_idx", "lat", "lon", "ele").unionByName(edges)
        ended = _pieces(whole, keys, horizontal_m, vertical_m).select(*_SEGMENT, "point_idx")
        tables.append(settled(found.union(ended), "simplify-kept"))
        open_ = counted.filter(F.col("_n") > most).select(*_SEGMENT, "a", "b", "_n", "_from")
    return reduce(DataFrame.union, tables).distinct()


def _pieces(points: DataFrame, keys: list[str], horizontal_m: float, vertical_m: float) -> DataFrame:
    """The kept points of stretches that each fit in a task."""

    def run(batches):
        held: pa.Table | None = None

        def ends(table: pa.Table) -> list[int]:
            """The rows at which stretches start, and the end."""
            changed = np.zeros(len(table), dtype=bool)
            changed[0] = True
            for k in keys:
                column = table.column(k).combine_chunks()
                changed[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
            return [*np.flatnonzero(changed).tolist(), len(table)]

        def done(table: pa.Table, edges: list[int]):
            lat, lon, ele = (pc.fill_null(table.column(c).combine_chunks(), np.nan).to_numpy(zero_copy_only=False) for c in ("lat", "lon", "ele"))
            keep = [_kept(lat[i:j], lon[i:j], ele[i:j], horizontal_m, vertical_m) for i, j in zip(edges, edges[1:])]
            return table.slice(0, edges[-1]).filter(pa.array(np.concatenate(keep))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            edges = ends(held)
            if len(edges) > 2:  # the last stretch may go on
                yield from done(held, edges[:-1])
                held = held.slice(edges[-2])
        if held is not None:
            yield from done(held, ends(held))

    ordered = points.repartition(*keys).sortWithinPartitions(*keys, "point_idx")
    return ordered.mapInArrow(run, points.schema)


def loops(requests: DataFrame) -> DataFrame:
    """A round route for each request (request_id, lat, lon, target_m, control_points, irregularity, rotation_deg, seed,
    samples_per_span, spacing_m) around its centre: a ring with jitter, rounded by a closed spline and scaled until its
    length is near the target.  Requests that make no sense give no points."""

    def ring(r, scale: float) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(r.control_points)
        wave = np.sin(r.seed * 12.9898 + i * 78.233) * 43758.5453
        jitter = (wave - np.floor(wave)) * 2 * r.irregularity - r.irregularity
        radius = r.target_m / (2 * np.pi) * scale * (1 + jitter)
        lat, lon = direct_arrays(r.lat, r.lon, r.rotation_deg + 360.0 * i / r.control_points, radius)
        lon = r.lon + (lon - r.lon + 180) % 360 - 180
        t = np.arange(r.samples_per_span) / r.samples_per_span

        def smooth(v: np.ndarray) -> np.ndarray:
            p0, p1, p2, p3 = (np.roll(v, k)[:, None] for k in (1, 0, -1, -2))
            line = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t**2 + (3 * p1 - p0 - 3 * p2 + p3) * t**3)
            return np.append(line.ravel(), v[0])

        lat, lon = smooth(lat), smooth(lon)
        return lat, np.where((lon > -180) & (lon <= 180), lon, 180 - (180 - lon) % 360)

    def dense(lat: np.ndarray, lon: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
        leg = inverse_arrays(lat[:-1], lon[:-1], lat[1:], lon[1:])[0]
        steps = np.where(leg > 0, np.maximum(1, np.ceil(leg / spacing)), 0).astype(int)
        at = np.repeat(np.arange(len(leg)), steps)
        t = (np.arange(len(at)) - np.repeat(np.cumsum(steps) - steps, steps) + 1) / steps[at]
        xyz = [np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)]) for p, q in ((np.radians(lat[k]), np.radians(lon[k])) for k in (at, at + 1))]
        omega = np.arccos(np.clip((xyz[0] * xyz[1]).sum(axis=0), -1, 1))
        flat = omega < 1e-12
        sine = np.where(flat, 1.0, np.sin(omega))
        x, y, z = xyz[0] * np.where(flat, 1.0, np.sin((1 - t) * omega) / sine) + xyz[1] * np.where(flat, 0.0, np.sin(t * omega) / sine)
        ends = t == 1
        new_lat = np.where(ends, lat[at + 1], np.degrees(np.arctan2(z, np.hypot(x, y))))
        new_lon = np.where(ends, lon[at + 1], np.degrees(np.arctan2(y, x)))
        return np.append(lat[:1], new_lat), np.append(lon[:1], new_lon)

    def route(r) -> tuple[np.ndarray, np.ndarray]:
        scale = 1.0
        for _ in range(3):
            lat, lon = dense(*ring(r, scale), r.spacing_m)
            length = float(inverse_arrays(lat[:-1], lon[:-1], lat[1:], lon[1:])[0].sum())
            scale *= r.target_m / length if length > 0 else 1.0
        return dense(*ring(r, scale), r.spacing_m)

    def run(frames):
        for frame in frames:
            ok = (frame.target_m > 0) & (frame.control_points >= 3) & frame.irregularity.between(0, 0.9) & (frame.samples_per_span >= 2)
            ok &= (frame.spacing_m > 0) & frame.lat.between(-90, 90) & frame.lon.between(-180, 180)
            for r in frame[ok].itertuples(index=False):
                lat, lon = route(r)
                yield pd.DataFrame({"track_id": r.request_id, "segment_idx": 0, "point_idx": range(len(lat)), "lat": lat, "lon": lon})

    made = requests.mapInPandas(run, "track_id string, segment_idx int, point_idx int, lat double, lon double")
    return made.select("*", F.lit(None).cast("double").alias("ele"), F.lit(None).cast("long").alias("time_ms"), F.lit(None).cast("double").alias("hacc_m"))


def flat_reverse(points: DataFrame) -> DataFrame:
    """The points of each track from last to first in one segment, times untouched."""
    order: Column = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("segment_idx"), F.desc("point_idx"))) - 1
    return points.select("track_id", F.lit(0).alias("segment_idx"), order.alias("point_idx"), "lat", "lon", "ele", "time_ms", "hacc_m")
