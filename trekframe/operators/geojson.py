"""GeoJSON of tracks as text columns: one document a track, ready for ``write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import distance, interpolate
from ..functions.scalars import band_color, gradient_band
from ..sources.tables import settled
from .sampling import sample, stretches
from .thinning import spaced_each
from .tracks import located
from .transforms import thin

EMPTY_COLLECTION = '{"type":"FeatureCollection","features":[]}'


def coordinate(lat: Column, lon: Column) -> Column:
    """[lon, lat] to six places, ties to even."""
    return F.array(F.rint(lon * 1e6) / 1e6, F.rint(lat * 1e6) / 1e6)


def _json(value: Column) -> Column:
    """JSON of nested arrays of numbers; to_json takes no bare arrays of arrays, so the wrapper is cut off."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _feature(geometry: Column, properties: str = "{}") -> Column:
    return F.concat(F.lit('{"type":"Feature","properties":' + properties + ',"geometry":'), geometry, F.lit("}"))


def _lines(lines: Column) -> Column:
    """A LineString for one line, else a MultiLineString, of an array of lines in order."""
    one = F.concat(F.lit('{"type":"LineString","coordinates":'), _json(F.get(lines, 0)), F.lit("}"))
    many = F.concat(F.lit('{"type":"MultiLineString","coordinates":'), _json(lines), F.lit("}"))
    return F.when(F.size(lines) == 1, one).otherwise(many)


def _in_order(rows: DataFrame, keys: list[str], order: Column, value: Column, name: str) -> DataFrame:
    """Values of a group as an array in an order."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))


def encode(points: DataFrame, fraction: float = 1.0) -> DataFrame:
    """track_id and geojson: a feature of each track, as far as a fraction of its walking distance reveals it."""
    here = coordinate(F.col("lat"), F.col("lon"))
    tracks = points.select("track_id").distinct()
    if fraction >= 1:
        rows = points.select("track_id", "segment_idx", F.col("point_idx").alias("at"), here.alias("c"))
    else:
        on_axis = located(points)
        part = Window.partitionBy("track_id", "segment_idx")
        total = F.max("cum_end_m").over(Window.partitionBy("track_id"))
        cut = on_axis.select(
            "*", (total * max(0.0, fraction)).alias("budget"), total.alias("total"), F.min("cum_start_m").over(part).alias("part_start"),
            F.max("cum_end_m").over(part).alias("part_end"),
        ).filter("total > 0 and budget > 0")
        # Whole segments, then of the segment in which the budget ends its points before and the cut itself.
        whole = F.col("part_end") <= F.col("budget")
        starts, first = F.col("part_start") < F.col("budget"), F.col("prev_lat").isNull()
        inside = starts & (first | ((F.col("leg_m") > 0) & (F.col("cum_start_m") < F.col("budget"))))
        t = F.least(F.lit(1.0), (F.col("budget") - F.col("cum_start_m")) / F.nullif("leg_m", F.lit(0.0)))
        place = interpolate(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"), F.coalesce(t, F.lit(1.0)))
        rows = cut.filter((whole & starts) | inside).withColumn("_p", F.when(whole | first, F.struct("lat", "lon")).otherwise(place))
        rows = rows.select("track_id", "segment_idx", F.col("point_idx").alias("at"), coordinate(F.col("_p.lat"), F.col("_p.lon")).alias("c"), whole.alias("whole"))
        few = F.count(F.lit(1)).over(Window.partitionBy("track_id", "segment_idx"))
        rows = rows.withColumn("_n", few).filter("whole or _n > 1").drop("_n", "whole")
    lines = _in_order(rows, ["track_id", "segment_idx"], F.col("at"), F.col("c"), "line")
    by_track = _in_order(lines, ["track_id"], F.col("segment_idx"), F.col("line"), "lines")
    filled = tracks.join(by_track, "track_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<array<array<double>>>")))
    return filled.select("track_id", _feature(_lines(F.col("lines"))).alias("geojson"))


def payload(geojson: Column) -> Column:
    """What a map is given: an empty collection where nothing is revealed."""
    return F.when(geojson.contains('"coordinates":[]'), F.lit(EMPTY_COLLECTION)).otherwise(geojson)


class Reveal:
    """Tracks prepared for being revealed again and again: what no fraction changes is found once.

    segments: a row for each spacing and segment with its start_m and end_m, its line as text when it is revealed as a whole
    (text), and the points drawn while it is revealed in part (way: their distances and texts); ends: the stretches in which a
    reveal can end, which no spacing changes.  segments are written and read again; ends may be, where many requests follow.
    """

    def __init__(self, segments: DataFrame, ends: DataFrame, spacings_m: tuple[float, ...] = (0.0,)):
        self.segments, self.ends, self.spacings_m = segments, ends, spacings_m

    @classmethod
    def of(cls, points: DataFrame, *spacings_m: float) -> Reveal:
        """A spacing thins the points that are drawn and nothing else: distances are of all points.  None is 0."""
        spacings_m = tuple(dict.fromkeys(map(float, spacings_m or (0.0,))))
        if min(spacings_m) < 0:
            raise ValueError("the spacing must not be negative")
        marked = spaced_each(points, list(spacings_m)).withColumn("c", _json(coordinate(F.col("lat"), F.col("lon"))))
        at, drawn = F.col("point_idx").alias("o"), []
        for i in range(len(spacings_m)):
            kept = F.col(f"_kept_{i}")
            # A repeated point draws nothing on the way; a whole segment has all that thinning leaves, and its end.
            way = kept & (F.col("prev_lat").isNull() | (F.col("leg_m") > 0))
            drawn += [
                F.array_sort(F.collect_list(F.when(kept | F.col("_last"), F.struct(at, "c")))).alias(f"_all_{i}"),
                F.array_sort(F.collect_list(F.when(way, F.struct(at, F.col("cum_end_m").alias("m"), "c")))).alias(f"_way_{i}"),
            ]
        segments = marked.groupBy("track_id", "segment_idx").agg(F.min("cum_start_m").alias("start_m"), F.max("cum_end_m").alias("end_m"), *drawn)
        text = lambda i: F.array_join(F.transform(f"_all_{i}", lambda x: x["c"]), ",")
        each = F.explode(F.array(*(F.struct(F.lit(s).alias("spacing_m"), text(i).alias("text"), F.col(f"_way_{i}").alias("way")) for i, s in enumerate(spacings_m))))
        segments = segments.select("track_id", "segment_idx", "start_m", "end_m", each.alias("_s")).select("track_id", "segment_idx", "start_m", "end_m", "_s.*")
        return cls(settled(segments, "reveal-segments"), stretches(points), spacings_m)

    def encode(self, requests: DataFrame) -> DataFrame:
        """track_id, fraction and geojson for requests (track_id, fraction), once each; unknown tracks are left out.  Of several
        spacings there is a row for each, with spacing_m.

        Requests meet the stretches in one ordered pass, which finds where each line ends; lines are then put together
        from the texts of the segments before and the points on the way.
        """
        totals = self.segments.groupBy("track_id").agg(F.max("end_m").alias("total_m"))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fraction")))
        asked = requests.select("track_id", F.col("fraction").cast("double").alias("fraction")).distinct().join(totals, "track_id")
        asked = asked.select("track_id", "fraction", (F.col("total_m") * share).alias("distance_m"))
        found = sample(self.ends, asked).select("track_id", "fraction", F.col("distance_m").alias("budget"), _json(coordinate(F.col("lat"), F.col("lon"))).alias("end"))
        met = found.filter("budget > 0").join(self.segments, "track_id").filter("end_m <= budget or start_m < budget")
        passed = F.transform(F.filter("way", lambda x: x["m"] <= F.col("budget")), lambda x: x["c"])
        part = F.array_join(F.concat(passed, F.array("end")), ",")
        keys = ["track_id", "fraction", "spacing_m"]
        drawn = met.select(*keys, "segment_idx", F.when(F.col("end_m") <= F.col("budget"), F.col("text")).otherwise(part).alias("line"))
        lines = _in_order(drawn, keys, F.col("segment_idx"), F.concat(F.lit("["), "line", F.lit("]")), "lines")
        each = F.explode(F.array(*map(F.lit, self.spacings_m)))
        every = asked.select("track_id", "fraction", each.alias("spacing_m")).join(lines, keys, "left")
        n, joined = F.size(F.coalesce("lines", F.array().cast("array<string>"))), F.coalesce(F.array_join("lines", ","), F.lit(""))
        one = F.concat(F.lit('{"type":"LineString","coordinates":'), joined, F.lit("}"))
        many = F.concat(F.lit('{"type":"MultiLineString","coordinates":['), joined, F.lit("]}"))
        shown = keys if len(self.spacings_m) > 1 else keys[:2]
        return every.select(*shown, _feature(F.when(n == 1, one).otherwise(many)).alias("geojson"))


def encode_thinned(points: DataFrame, fraction: float, spacing_m: float) -> DataFrame:
    """track_id and geojson as encode() gives them, of lines whose points are at least a spacing apart.  A line ends where
    the track reaches the fraction of its whole length, however few points are drawn."""
    requests = points.select("track_id", F.lit(float(fraction)).alias("fraction"))
    return Reveal.of(points, spacing_m).encode(requests).drop("fraction")


def gradient_features(points: DataFrame, spacing_m: float = 30.0) -> DataFrame:
    """track_id, segment_idx, point_idx, band, color, geojson: a coloured two-point feature for each stretch of the
    thinned track; the gradient is unknown for stretches under half the spacing or without heights."""
    thinned = thin(points, spacing_m)
    order = Window.partitionBy("track_id", "segment_idx").orderBy("point_idx")
    pairs = thinned.select("*", *(F.lag(c).over(order).alias(f"p_{c}") for c in ("lat", "lon", "ele"))).filter("p_lat is not null")
    pairs = pairs.withColumn("m", distance("p_lat", "p_lon", "lat", "lon"))
    grade = F.when(F.col("m") >= spacing_m / 2, (F.col("ele") - F.col("p_ele")) / F.nullif("m", F.lit(0.0)) * 100.0)
    named = pairs.withColumn("band", gradient_band(grade)).withColumn("color", band_color(F.col("band")))
    line = F.array(coordinate(F.col("p_lat"), F.col("p_lon")), coordinate(F.col("lat"), F.col("lon")))
    head = F.concat(F.lit('{"type":"Feature","properties":{"band":"'), F.col("band"), F.lit('","color":"'), F.col("color"), F.lit('"},"geometry":'))
    text = F.concat(head, F.lit('{"type":"LineString","coordinates":'), _json(line), F.lit("}}"))
    return named.select("track_id", "segment_idx", "point_idx", "band", "color", text.alias("geojson"))


def collection(features: DataFrame) -> DataFrame:
    """track_id and geojson: the features of a track as one collection."""
    order = F.struct("segment_idx", "point_idx")
    found = _in_order(features, ["track_id"], order, F.col("geojson"), "all")
    return found.select("track_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("all", ","), F.lit("]}")).alias("geojson"))


def encode_waypoints(waypoints: DataFrame) -> DataFrame:
    """track_id and geojson: the waypoints (track_id, wpt_idx, name, lat, lon) as numbered, labelled points."""
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("wpt_idx"))
    label = F.coalesce("name", F.col("number").cast("string"))
    properties = F.to_json(F.struct(F.col("number").alias("index"), label.alias("label")))
    text = F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"Point","coordinates":'),
        _json(coordinate(F.col("lat"), F.col("lon"))), F.lit("}}"),
    )
    rows = waypoints.withColumn("number", number).select(
        "track_id", F.lit(0).alias("segment_idx"), F.col("number").alias("point_idx"), text.alias("geojson")
    )
    return collection(rows)
