import zlib
import struct
import itertools
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trekframe.functions.geodesy import direct_arrays
from trekframe.operators import dem, flyover, framing, geojson, map_style, profile, sampling, splits, tracks, transforms
from trekframe.plans import more_queries
from trekframe.schema import POINTS
from trekframe.sources import catalog, derived, gpx, tiles


def run_of(track, legs, spacing=100.0, grade=0.0, start=(46.0, 7.0), segment=0, timed=True, t0=1_700_000_000_000):
    lat, lon = direct_arrays([start[0]] * (legs + 1), [start[1]] * (legs + 1), [90.0] * (legs + 1), [i * spacing for i in range(legs + 1)])
    return [(track, segment, i, float(a), float(o), i * spacing * grade / 100, t0 + 60_000 * i if timed else None, None) for i, (a, o) in enumerate(zip(lat, lon, strict=True))]


def heights(track, values, segment=0, timed=None):
    return [(track, segment, i, 46.0 + i * 0.001 + segment * 0.1, 7.0, v, timed[i] if timed else None, None) for i, v in enumerate(values)]


@pytest.fixture
def table(spark):
    return lambda *parts: spark.createDataFrame([r for p in parts for r in p], POINTS)


def by_track(df):
    return {r.track_id: r for r in df.collect()}


def test_climb_needs_more_than_the_threshold(table):
    points = table(
        heights("a", [1000.0, 1300.0, 1100.0]), heights("b", [0.0, 1.0, 2.0]), heights("c", [0.0, 3.0, None, 3.1]), heights("d", [None, None]), heights("e", [5.0, float("nan"), 9.0])
    )
    found = by_track(tracks.track_stats(points))
    assert (found["a"].gain_m, found["a"].loss_m, found["a"].min_ele, found["a"].max_ele) == (300, 200, 1000, 1300)
    assert found["b"].gain_m == 0 and found["c"].gain_m == pytest.approx(3.1) and found["d"].gain_m == 0 and found["d"].min_ele is None and found["e"].gain_m == 4
    assert by_track(tracks.track_stats(points, threshold=0.0))["b"].gain_m == 2


def test_climb_over_a_gap_counts_only_in_the_flat_form(table):
    points = table(heights("a", [0.0, 100.0]), heights("a", [900.0, 1000.0], 1))
    assert by_track(tracks.elevation_gain(points))["a"].gain_m == 200
    assert by_track(tracks.elevation_gain(points, gap_reset=False))["a"].gain_m == 1000
    assert by_track(tracks.track_stats(points))["a"].gain_m == 1000
    assert by_track(tracks.track_stats(points, gap_reset=True))["a"].gain_m == 200


def test_times(table):
    points = table(
        heights("pause", [None] * 3, timed=[0, 60_000, 660_000]), heights("two", [None] * 2, timed=[0, 60_000]), heights("two", [None] * 2, 1, timed=[3_600_000, 3_660_000]),
        heights("none", [None] * 2), [("slow", 0, 0, 46.0, 7.0, None, 0, None), ("slow", 0, 1, 46.00004, 7.0, None, 60_000, None)],
    )
    found = by_track(tracks.track_stats(points))
    assert (found["pause"].elapsed_ms, found["pause"].moving_ms) == (660_000, 60_000)
    assert (found["two"].elapsed_ms, found["two"].moving_ms) == (3_660_000, 120_000)
    assert found["none"].elapsed_ms is None and found["none"].moving_ms is None
    assert found["slow"].moving_ms == 0 and found["slow"].moving_mps is None and found["slow"].distance_m > 0
    assert found["pause"].moving_mps == pytest.approx(found["pause"].distance_m / 60)


def test_analysis(table):
    found = by_track(tracks.route_analysis(table(run_of("up", 30, grade=8), heights("flat", [None] * 4))))
    assert found["up"].steepest_climb_pct == pytest.approx(8, abs=0.01) and found["up"].steepest_descent_pct is None and found["up"].difficulty == "EASY"
    assert found["flat"].average_gradient_pct is None and found["flat"].walking_s > 0
    samples = profile.profile(table(run_of("up", 30, grade=8), heights("flat", [None] * 4)))
    bands = by_track(tracks.dominant_bands(tracks.band_fractions(samples)))
    assert bands["up"].dominant_band == "CLIMB" and bands["flat"].dominant_band == "UNKNOWN"
    assert sum(bands["up"].gradient_distribution.values()) == pytest.approx(1)


def test_profile(table):
    points = table(run_of("a", 20, grade=5), run_of("a", 20, start=(46.5, 7.5), segment=1), heights("dot", [7.0]), heights("same", [3.0])[:1] * 1)
    samples = profile.profile(points, 41)
    rows = [r for r in samples.orderBy("sample_idx").collect() if r.track_id == "a"]
    assert len(rows) == 41 and rows[0].gradient_pct is None and rows[-1].distance_m == pytest.approx(4000, abs=0.01)
    assert rows[5].gradient_pct == pytest.approx(5, abs=0.01) and sum(r.is_across_gap for r in rows) == 1
    assert next(r for r in rows if r.is_across_gap).gradient_pct is None
    assert [(r.sample_idx, r.ele) for r in samples.collect() if r.track_id == "dot"] == [(0, 7.0)]
    with pytest.raises(ValueError):
        profile.profile(points, 1)
    chart = profile.filled(samples.withColumn("ele", F.when(F.col("sample_idx") > 3, F.col("ele"))))
    assert chart.filter("chart_ele is null").count() == 0
    runs = profile.band_runs(samples).filter("track_id = 'a'").agg(F.sum(F.col("last_idx") - F.col("first_idx") + 1)).first()[0]
    assert runs == 41


def test_splits(table):
    rows = splits.splits(table(run_of("a", 35))).orderBy("split_idx").collect()
    assert [r.distance_m for r in rows] == pytest.approx([1000, 1000, 1000, 500], abs=0.5) and [r.is_partial for r in rows] == [False] * 3 + [True]
    climb = splits.splits(table(run_of("a", 50, grade=10))).collect()
    assert len(climb) == 5 and all(r.gain_m == pytest.approx(100, abs=1) and r.gradient_pct == pytest.approx(10, abs=0.05) for r in climb)
    miles = splits.splits(table(run_of("a", 40)), splits.MILE).orderBy("split_idx").collect()
    assert len(miles) == 3 and miles[0].distance_m == pytest.approx(1609.344, abs=0.5)


def test_split_climbs_add_up_over_straddled_cuts(table):
    points = table(run_of("a", 12, spacing=730, grade=6), run_of("a", 5, spacing=430, grade=-7, start=(46.4, 7.0), segment=1))
    gains = {how: splits.splits(points, attribution=how).agg(F.sum("gain_m"), F.sum("loss_m"), F.sum("seconds"), F.sum("distance_m")).first() for how in ("proportional", "first_piece")}
    whole = by_track(tracks.elevation_gain(points))["a"]
    stats = by_track(tracks.route_analysis(points))["a"]
    both = gains["proportional"]
    assert (both[0], both[1]) == pytest.approx((whole.gain_m, whole.loss_m)) and (both[2], both[3]) == pytest.approx((stats.walking_s, stats.distance_m))
    assert gains["first_piece"][0] < both[0] - 1 and gains["first_piece"][2] == pytest.approx(both[2])
    with pytest.raises(ValueError):
        splits.splits(points, 0.0)


def test_a_missing_height_clears_the_reference_of_splits(table):
    points = table(heights("a", [0.0, 50.0, None, 300.0, 310.0]))
    assert splits.splits(points).agg(F.sum("gain_m")).first()[0] == pytest.approx(60)


def test_sampling_over_a_gap(table):
    lats = [(46.0, 46.0018), (46.0027, 46.0045)]
    points = table([("g", s, i, lat, 7.0, 100.0 * (2 * s + i), None, None) for s, pair in enumerate(lats) for i, lat in enumerate(pair)], heights("dot", [5.0]))
    known = sampling.stretches(points)
    totals = known.filter("track_id = 'g'").first()
    middle = totals.total_flight_m / 2
    asked = points.sparkSession.createDataFrame(
        [("g", middle), ("g", -5.0), ("g", 1e9), ("dot", 3.0), ("nobody", 1.0)], "track_id string, distance_m double"
    )
    flown = {(r.track_id, r.distance_m): r for r in sampling.sample(known, asked, "flight").collect()}
    mid = flown["g", middle]
    assert mid.lat == pytest.approx(46.00225, abs=2e-5) and mid.ele == pytest.approx(150, abs=2) and mid.segment_idx == 0
    assert mid.walked_m == pytest.approx(200.2, abs=0.5)
    assert flown["g", -5.0].lat == 46.0 and flown["g", 1e9].lat == pytest.approx(46.0045) and flown["g", 1e9].walked_m == pytest.approx(totals.total_walk_m)
    assert (flown["dot", 3.0].lat, flown["dot", 3.0].bearing, flown["dot", 3.0].ele) == (46.0, 0.0, 5.0) and flown["nobody", 1.0].lat is None
    halves = sampling.sample_fractions(known, points.select("track_id").distinct().withColumn("fraction", F.lit(0.5)))
    assert by_track(halves)["g"].segment_idx == 1


def test_transforms(table):
    points = table(run_of("a", 3, timed=True), run_of("a", 2, start=(46.2, 7.0), segment=1, timed=False))
    back = transforms.reverse(points).orderBy("segment_idx", "point_idx").collect()
    assert [r.segment_idx for r in back] == [0] * 3 + [1] * 4 and back[3].time_ms == 1_700_000_000_000 and back[0].time_ms is None
    assert sorted(map(str, transforms.reverse(transforms.reverse(points)).collect())) == sorted(map(str, points.collect()))
    dense = transforms.densify(points, 30.0)
    legs = tracks.legs(dense).agg(F.max("leg_m"), F.sum("leg_m")).first()
    assert legs[0] <= 30 and legs[1] == pytest.approx(500, abs=0.01) and dense.filter("time_ms is not null").count() == 1
    merged = transforms.merge(points.withColumn("part_idx", F.lit(0)).union(points.withColumn("part_idx", F.lit(1))))
    assert sorted({r.segment_idx for r in merged.collect()}) == [0, 1, 2, 3]
    thin = transforms.thin(table(run_of("t", 10)), 250.0).orderBy("point_idx").collect()
    assert [r.point_idx for r in thin] == [0, 3, 6, 9, 10]
    assert [r.point_idx for r in transforms.flat_reverse(points).orderBy("point_idx").collect()] == list(range(7))
    stops = points.filter("segment_idx = 0").select("track_id", F.col("point_idx").alias("wpt_idx"), "lat", "lon", "ele", "time_ms")
    loop = transforms.from_waypoints(stops, closed=True).orderBy("point_idx").collect()
    assert loop[0].lat == loop[-1].lat and len(loop) > 20
    for wrong in (lambda: transforms.densify(points, 0.0), lambda: transforms.thin(points, -1.0), lambda: transforms.simplify(points, -1.0)):
        with pytest.raises(ValueError):
            wrong()


def test_simplify(table):
    straight = run_of("straight", 4)
    bent = [(("bent"), *r[1:]) for r in run_of("x", 2)]
    bent[1] = (*bent[1][:3], bent[1][3] + 0.01, *bent[1][4:])
    spike = [("spike", *r[1:5], 200.0 if r[2] == 1 else 0.0, *r[6:]) for r in run_of("x", 2)]
    kept = transforms.simplify(table(straight, bent, spike)).groupBy("track_id").count()
    assert {r.track_id: r["count"] for r in kept.collect()} == {"straight": 2, "bent": 3, "spike": 3}


@pytest.mark.parametrize("metres", [3000.0, 15000.0])
def test_loops_have_the_length_asked_for(spark, metres):
    ask = [("ok", 46.0, 7.0, metres, 9, 0.28, 37.0, 1, 10, 25.0), ("bad", 46.0, 7.0, -1.0, 9, 0.28, 37.0, 1, 10, 25.0)]
    names = "request_id string, lat double, lon double, target_m double, control_points int, irregularity double, rotation_deg double, seed long, samples_per_span int, spacing_m double"
    made = transforms.loops(spark.createDataFrame(ask, names))
    found = by_track(tracks.track_stats(made))
    assert set(found) == {"ok"} and found["ok"].distance_m == pytest.approx(metres, rel=0.05)


def test_framing(table):
    view = by_track(framing.cameras(table(run_of("a", 10, spacing=1000), heights("dot", [1.0]))))
    assert view["a"].diagonal_km == pytest.approx(10, abs=0.1) and view["a"].tilt == 60 and 12 < view["a"].zoom < 13 and view["dot"].zoom == 15


def test_terrain(spark, table):
    tile = dem.tile_for(F.lit(45.9), F.lit(6.9), F.lit(13))
    x, y = spark.range(1).select(tile.alias("t")).first().t
    flat = spark.createDataFrame([(13, x, y, [int((32768 + 1234.5) * 256)] * 65536), (13, x + 1, y, [0] * 65536), (12, 0, 0, [1, 2])], "zoom int, x int, y int, pixels array<int>")
    at = spark.createDataFrame([(1, 45.9, 6.9, 13), (2, 45.9, 6.9 + 360 / 8192, 13), (3, 10.0, 10.0, 13), (4, 95.0, 6.9, 13)], "k int, lat double, lon double, zoom int")
    found = {r.k: r.dem_ele for r in dem.sampled(at, flat).collect()}
    assert found == {1: 1234.5, 2: None, 3: None, 4: None}  # -32768 m is implausible
    points = table([("a", 0, 0, 45.9, 6.9, None, None, None), ("a", 0, 1, 45.9, 6.9, 5.0, None, None)], [("b", 0, 0, 10.0, 10.0, None, None, None)])
    filled = dem.fill(points, flat)
    assert {(r.track_id, r.point_idx): (r.ele, r.filled) for r in filled.collect()} == {("a", 0): (1234.5, True), ("a", 1): (5.0, False), ("b", 0): (None, False)}
    assert [tuple(r) for r in dem.fill_report(points, filled).collect()] == [("a", 13, 1, 1)]
    wide = table([("w", 0, i, 46.0, 0.04 * i, None, None, None) for i in range(200)])
    assert dem.fill_zooms(wide, 8).first().zoom < 13 and dem.fill_zooms(wide, 2).count() <= 1
    assert spark.range(1).select(dem.tile_for(F.lit(0.0), F.lit(180.0), F.lit(3)).alias("t")).first().t.x == 8
    assert spark.range(1).select(dem.tiles_per_axis(F.lit(23)).alias("t")).first().t is None


def test_tiles_are_made_once_and_few_at_a_time(table):
    points = table([("a", 0, i, 45.9, 6.9 + i * 1e-6, None, None, None) for i in range(20)])
    filled = dem.fill(points, more_queries._tiles_for(points))
    assert filled.filter("filled").count() == 20
    made = [n for n in filled._jdf.queryExecution().optimizedPlan().toString().split("\n") if "_surface" in n]
    assert len(made) == 1
    keys = pd.DataFrame({"zoom": 13, "x": range(100), "y": 7})
    parts = list(derived._surface([keys]))
    assert max(map(len, parts)) <= derived.TILES_AT_ONCE < 100 and pd.concat(parts)["x"].tolist() == list(range(100))


def test_geojson(table):
    points = table(run_of("one", 2), run_of("two", 1), run_of("two", 1, start=(46.2, 7.0), segment=1))
    whole = {k: json.loads(r.geojson) for k, r in by_track(geojson.encode(points)).items()}
    assert whole["one"]["geometry"]["type"] == "LineString" and whole["one"]["geometry"]["coordinates"][0] == [7.0, 46.0]
    assert [len(x) for x in whole["two"]["geometry"]["coordinates"]] == [2, 2]
    part = {k: json.loads(r.geojson) for k, r in by_track(geojson.encode(points, 0.25)).items()}
    line = part["one"]["geometry"]["coordinates"]
    assert len(line) == 2 and line[1][0] - 7.0 == pytest.approx((whole["one"]["geometry"]["coordinates"][1][0] - 7.0) / 2, abs=1e-6)
    none = geojson.encode(points, 0.0).select(geojson.payload(F.col("geojson")).alias("g")).first().g
    assert none == geojson.EMPTY_COLLECTION
    lengths = [sum(len(x) for x in json.loads(r.geojson)["geometry"]["coordinates"]) for f in (0.3, 0.6, 0.9, 1.0) for r in geojson.encode(points, f).filter("track_id = 'two'").collect() if "Multi" in r.geojson]
    assert lengths == sorted(lengths)
    features = json.loads(geojson.collection(geojson.gradient_features(table(run_of("up", 4, grade=9)))).first().geojson)["features"]
    assert [f["properties"] for f in features] == [{"band": "CLIMB", "color": "#EF8534"}] * 4
    marks = points.filter("point_idx = 0").select("track_id", F.col("segment_idx").alias("wpt_idx"), F.when(F.col("segment_idx") == 1, 'a "b"').alias("name"), "lat", "lon")
    labels = [f["properties"] for f in json.loads(by_track(geojson.encode_waypoints(marks))["two"].geojson)["features"]]
    assert labels == [{"index": 1, "label": "1"}, {"index": 2, "label": 'a "b"'}]


def test_map_styles():
    base = json.dumps({"layers": [{"id": k, "type": t} for k, t in (("land", "fill"), ("arrows", "symbol"), ("walls", "line"), ("names", "symbol"))]})
    line, marks = '{"type":"Feature","geometry":null}', geojson.EMPTY_COLLECTION
    steps = [map_style.with_terrain, lambda s: map_style.with_track(s, line), lambda s: map_style.with_gradients(s, marks), lambda s: map_style.with_waypoints(s, marks)]
    made = set()
    for order in itertools.permutations(steps):
        style = base
        for step in (*order, order[0]):  # one of them twice
            style = step(style)
        found = json.loads(style)
        made.add(json.dumps([found["layers"], dict(sorted(found["sources"].items()))], sort_keys=True))
    assert len(made) == 1
    assert [x["id"] for x in found["layers"]] == [
        "land", "trek-shade", "arrows", "walls", "trek-track-casing", "trek-track-line", "trek-gradient-casing", "trek-gradient-line", "trek-waypoint-circles", "names", "trek-captions",
    ]
    assert found["terrain"] == {"source": "trek-terrain", "exaggeration": 1.35}
    assert map_style.with_terrain_and_track(base) == map_style.with_terrain(base)
    assert [x["id"] for x in json.loads(map_style.with_terrain_and_track("{}", line))["layers"]] == ["trek-shade", "trek-track-casing", "trek-track-line"]


def png(pixels, kinds=(0,), color=2):
    """A PNG of (rows, columns, samples) bytes whose rows take turns with the filters."""
    rows, columns, samples = pixels.shape
    above, data = np.zeros((columns, samples), dtype=int), b""
    for i, row in enumerate(pixels.astype(int)):
        kind = kinds[i % len(kinds)]
        left = np.vstack([np.zeros((1, samples), dtype=int), row[:-1]])
        corner = np.vstack([np.zeros((1, samples), dtype=int), above[:-1]])
        near = left + above - corner
        far = [abs(near - x) for x in (left, above, corner)]
        paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
        data += bytes([kind]) + ((row - (0, left, above, (left + above) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes()
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", columns, rows, 8, color, 0, 0, 0)
    packed = zlib.compress(data)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:99]) + chunk(b"IDAT", packed[99:]) + chunk(b"IEND", b"")


def test_tiles_from_files(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (256, 256, 4), dtype=np.uint8)
    wanted = [int(np.int32(np.uint32(int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b)))) for r, g, b, a in pixels[:2].reshape(-1, 4)[:300]]
    (tmp_path / "13_4_5.png").write_bytes(png(pixels, (4, 3, 2, 1, 0), color=6))
    (tmp_path / "13_4_6.png").write_bytes(png(pixels[..., :3], (1, 4)))
    (tmp_path / "9_1_2.png").write_bytes(png(pixels[:100, :100, :3]))  # not the size of a tile
    (tmp_path / "9_1_3.png").write_bytes(b"no picture")
    (tmp_path / "9_1_4.png").write_bytes(png(pixels)[:5000])
    (tmp_path / "other.png").write_bytes(png(pixels[..., :3]))
    found = {(r.zoom, r.x, r.y): r.pixels for r in tiles.read_tiles(spark, str(tmp_path)).collect()}
    assert sorted(found) == [(13, 4, 5), (13, 4, 6)]
    assert found[13, 4, 5][:300] == wanted
    assert [x & 0xFFFFFF for x in found[13, 4, 6][:300]] == [x & 0xFFFFFF for x in wanted] and min(x >> 24 for x in found[13, 4, 6]) == -1


def test_flyover(table):
    points = table(run_of("a", 20, spacing=200), run_of("a", 10, spacing=200, start=(46.0, 7.1), segment=1), heights("dot", [3.0]))
    rows = [r for r in flyover.frames(points, 250).orderBy("elapsed_ms").collect() if r.track_id == "a"]
    assert rows[0].phase == "Intro" and rows[0].zoom == 11 and rows[0].revealed == 0 and rows[-1].phase == "Outro" and rows[-1].progress == 1 and rows[-1].zoom == 10.5
    revealed = [r.revealed for r in rows]
    assert revealed == sorted(revealed) and len({r.walked_m for r in rows if r.phase == "Travel"}) < sum(r.phase == "Travel" for r in rows)
    turns = [abs((b.bearing - a.bearing + 180) % 360 - 180) for a, b in zip(rows, rows[1:], strict=False) if a.phase == b.phase == "Travel"]
    assert max(turns) < 5
    assert by_track(flyover.frames(points, 10**6).filter("phase = 'Outro'"))["dot"].here_lat == 46.0
    with pytest.raises(ValueError):
        flyover.FlyoverOptions(intro_ms=-1)


HEAD = '<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1">'


def test_no_window_of_a_flight_looks_at_all_later_rows_for_each_row(table):
    plan = flyover.frames(table(run_of("a", 30)), 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_gpx_parsing(spark):
    odd = (
        f"{HEAD}<metadata><name> A </name></metadata><rte><rtept lat='1' lon='2'/></rte><TRK><name>B</name><trkpt lat='3' lon='4'><ele>7.5</ele>"
        "<time>2024-05-01T10:00:00Z</time></trkpt><trkseg><trkpt lat='5' lon='6'/><trkpt lat='95' lon='6'/><trkpt lon='6'/></trkseg><trkseg/></TRK>"
        "<wpt lat='1' lon='1'><name>W</name></wpt></gpx>"
    )
    bad = ["<gpx>", "<html/>", "", f'<!DOCTYPE x [<!ENTITY a SYSTEM "file:///etc/passwd">]>{HEAD}&a;</gpx>']
    files = spark.createDataFrame([("odd", odd), *((f"bad{i}", x) for i, x in enumerate(bad))], "path string, xml string")
    found = gpx.read_gpx(files)
    rows = [(r.segment_idx, r.lat, r.ele, r.time_ms) for r in found["points"].orderBy("segment_idx", "point_idx").collect()]
    assert rows == [(0, 5.0, None, None), (1, 3.0, 7.5, 1714557600000), (2, 1.0, None, None)]
    assert [(r.name, r.description) for r in found["documents"].collect()] == [("A", None)] and [r.name for r in found["waypoints"].collect()] == ["W"]
    assert sorted(r.track_id for r in found["errors"].collect()) == [f"bad{i}" for i in range(4)]


def test_gpx_rows_are_handed_over_a_few_at_a_time(spark, monkeypatch):
    """The frames that come out of one batch of files are bounded."""
    monkeypatch.setattr(gpx, "ROWS_AT_ONCE", 7)
    text = "<gpx><trk><trkseg>" + "<trkpt lat='1' lon='2'/>" * 5 + "</trkseg></trk></gpx>"
    taken = []

    class Files:
        columns = ["path", "xml"]

        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            taken.extend(run([pd.DataFrame({"path": list("abcd"), "xml": [text, "<gpx", text, text]})]))

    gpx._parsed(Files())
    assert max(map(len, taken)) <= 7
    kinds = pd.concat(taken)[["track_id", "kind"]].value_counts().to_dict()
    assert kinds == {(t, k): n for t in "acd" for k, n in (("point", 5), ("document", 1))} | {("b", "error"): 1}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "iso-8859-1", "utf-8-sig"])
def test_gpx_files_are_read_in_their_encoding(spark, tmp_path, encoding):
    declared = "" if encoding == "utf-8-sig" else f"<?xml version='1.0' encoding='{encoding}'?>"
    (tmp_path / "a.gpx").write_bytes(f"{declared}{HEAD}<trk><name>Höhe</name><trkpt lat='1' lon='2'/></trk></gpx>".encode(encoding))
    (tmp_path / "b.gpx").write_bytes(b"\xff\xfe\x00broken")
    found = gpx.read_gpx(gpx.read_files(spark, str(tmp_path)))
    assert [r.name for r in found["documents"].collect()] == ["Höhe"] and found["points"].count() == found["errors"].count() == 1


def test_gpx_writing(spark, table, tmp_path):
    points = table(run_of("a", 2, grade=5), run_of("a", 1, start=(46.2, 7.0), segment=1, timed=False))
    names = spark.createDataFrame([("a", "Up & <over>", None)], "track_id string, name string, description string")
    marks = spark.createDataFrame([("a", 0, "it's", 46.0, 7.0, None, 5)], "track_id string, wpt_idx int, name string, lat double, lon double, ele double, time_ms long")
    xml = gpx.write_gpx(points, names, marks).first().xml
    assert "<name>Up &amp; &lt;over&gt;</name>" in xml and "it&apos;s" in xml and xml.index("<wpt") < xml.index("<trk>")
    (tmp_path / "a.gpx").write_text(xml)
    back = gpx.read_gpx(gpx.read_files(spark, str(tmp_path)))
    got = back["points"].orderBy("segment_idx", "point_idx").collect()
    assert [(r.segment_idx, r.time_ms) for r in got] == [(r.segment_idx, r.time_ms) for r in points.orderBy("segment_idx", "point_idx").collect()]
    assert back["documents"].first().name == "Up & <over>" and back["waypoints"].first().time_ms is None


def test_route_library(spark, table, tmp_path):
    library = catalog.RouteLibrary(spark, str(tmp_path / "routes"))
    assert library.list().count() == 0
    old = "old-" + library.save(table(run_of("old", 3)), F.lit("  "), F.lit(1))
    new = "new-" + library.save(table(run_of("new", 4)), F.lit(" Ridge "), F.lit(2))
    assert [(r.id, r.name, r.point_count) for r in library.list().collect()] == [(new, "Ridge", 5), (old, catalog.DEFAULT_NAME, 4)]
    assert library.load(old).count() == 4
    written = library.gpx(new).collect()
    assert [r.track_id for r in written] == [new] and "<name>Ridge</name>" in written[0].xml and written[0].xml.count("<trkpt") == 5
    again = "old-" + library.save(table(run_of("old", 3)), F.lit("again"), F.lit(3))
    library.delete(old)
    library.delete("never was")
    assert [r.id for r in library.list().collect()] == [again, new] and library.load(old).count() == library.gpx(old).count() == 0
    assert library.load(again).count() == 4
