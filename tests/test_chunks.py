"""Tracks cut into chunks give what whole tracks give, and keep several tasks busy."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trekframe.operators import climb, geojson, profile, thinning, tracks, transforms
from trekframe.schema import POINTS


@pytest.fixture(scope="module")
def walked(spark):
    """A long track of two segments with repeated points and missing heights, a short one, one of a single point, one without heights."""
    rng = random.Random(2)
    rows = []

    def add(track, segment, n, heights=True):
        lat, lon, ele = 45 + rng.random(), 7 + rng.random(), 500.0
        for i in range(n):
            if rng.random() > 0.1:
                lat, lon = lat + rng.uniform(-2e-4, 4e-4), lon + rng.uniform(-2e-4, 4e-4)
            ele += rng.choice([0, 0.5, -0.5, 1.5, -1.2, 4, -4])
            rows.append((track, segment, 3 * i, lat, lon, ele if heights and rng.random() > 0.15 else None, 1000 * i, None))

    add("long", 0, 173), add("long", 1, 88), add("long", 3, 1), add("short", 0, 4), add("point", 0, 1), add("flat", 0, 60, False)
    return spark.createDataFrame(rows, POINTS).repartition(3).cache()


def found(df, places=6):
    return sorted(str(tuple(round(v, places) + 0.0 if isinstance(v, float) else v for v in r)) for r in df.collect())


@pytest.fixture(params=[7])
def small_chunks(request, monkeypatch):
    monkeypatch.setattr(tracks, "CHUNK", request.param)
    return request.param


def whole(make, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(tracks, "CHUNK", 1 << 30)
        return found(make())


MAKERS = {
    "legs": lambda p: tracks.legs(p),
    "stats": lambda p: tracks.track_stats(p),
    "stats by segment": lambda p: tracks.track_stats(p, gap_reset=True),
    "analysis": lambda p: tracks.route_analysis(p),
    "profile": lambda p: profile.profile(p, 50),
    "thin": lambda p: transforms.thin(p, 45.0),
    "gradients": lambda p: geojson.gradient_features(p, 30.0),
    "reveal": lambda p: geojson.encode_thinned(p, 0.47, 60.0),
}


@pytest.mark.parametrize("name", MAKERS)
def test_chunks_do_not_show(walked, small_chunks, monkeypatch, name):
    assert found(MAKERS[name](walked)) == whole(lambda: MAKERS[name](walked), monkeypatch)


def plain_climb(heights, threshold):
    ref, gain, loss = None, 0.0, 0.0
    for h in heights:
        if h is None or not math.isfinite(h):
            continue
        if ref is None:
            ref = h
        elif abs(h - ref) > threshold:
            gain, loss, ref = gain + max(0.0, h - ref), loss + max(0.0, ref - h), h
    return gain, loss


@pytest.mark.parametrize(("threshold", "gap_reset"), [(0.0, True), (3.0, False)])
def test_climb_is_that_of_a_plain_fold(walked, threshold, gap_reset, monkeypatch):
    monkeypatch.setattr(tracks, "CHUNK", 20)
    by_track = {}
    for r in sorted(walked.collect(), key=lambda r: (r.track_id, r.segment_idx, r.point_idx)):
        by_track.setdefault(r.track_id, {}).setdefault(r.segment_idx if gap_reset else 0, []).append(r.ele)
    wanted = {}
    for track, parts in by_track.items():
        each = [plain_climb(p, threshold) for p in parts.values()]
        wanted[track] = (pytest.approx(sum(g for g, _ in each)), pytest.approx(sum(x for _, x in each)))
    assert {r.track_id: (r.gain_m, r.loss_m) for r in tracks.elevation_gain(walked, threshold, gap_reset).collect()} == wanted


@pytest.mark.parametrize("seed", range(20))
def test_summaries_answer_every_reference(seed):
    import numpy as np

    rng = random.Random(seed)
    heights = np.cumsum([rng.choice([0.0, 1.0, -1.0, 0.3, 5.0, -5.0]) for _ in range(rng.randrange(1, 60))])
    records = climb.summary(heights, 3.0)
    for ref in np.arange(heights[0] - 9, heights[0] + 9, 0.7):
        gain, loss = plain_climb([ref, *heights], 3.0)
        out = climb.moved(records, float(ref), 3.0)
        assert out[:2] == (pytest.approx(gain), pytest.approx(loss))
    assert climb.moved(records, None, 3.0)[:2] == tuple(map(pytest.approx, plain_climb(heights, 3.0)))


@pytest.mark.parametrize("seed", range(20))
def test_thinning_summaries_answer_every_distance_behind(seed):
    import numpy as np

    rng = random.Random(seed)
    lengths = np.array([rng.choice([0.0, 1.0, 2.5, 7.0, 40.0]) for _ in range(rng.randrange(1, 50))])
    at, out = thinning.candidates(lengths, 20.0)
    for behind in np.arange(0, 20, 0.9):
        since = behind
        for m in lengths:
            since = 0.0 if since + m >= 20.0 - 1e-12 else since + m
        assert thinning.behind_end(at, out, float(lengths.sum()), float(behind), 20.0) == pytest.approx(since)


def test_simplification_in_rounds_keeps_the_same_points(walked):
    assert found(transforms.simplify(walked, 9.0, 3.0, 60)) == found(transforms.simplify(walked, 9.0, 3.0))


def test_one_track_keeps_several_tasks_busy(spark):
    n = 20_000
    points = spark.range(n).select(
        F.lit("t").alias("track_id"), F.lit(0).alias("segment_idx"), F.col("id").cast("int").alias("point_idx"), (F.lit(45.0) + F.col("id") * 1e-5).alias("lat"),
        F.lit(7.0).alias("lon"), (F.sin(F.col("id") / 50.0) * 20).alias("ele"), F.col("id").alias("time_ms"), F.lit(None).cast("double").alias("hacc_m"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # joins small partitions, as there are few rows
    try:
        held = tracks.on_axis(points, 500).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in held) == n and max(r.n for r in held) < n / 2
    plan = tracks.track_stats(points)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def coordinates(text):
    geometry = json.loads(text)["geometry"]
    return geometry["coordinates"] if geometry["type"] == "MultiLineString" else [geometry["coordinates"]]


def test_a_thinned_reveal_ends_where_the_track_does(walked):
    fractions = [k / 20 for k in range(21)]
    requests = walked.select("track_id").distinct().select("track_id", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    exact, thinned = ({(r.track_id, r.fraction): coordinates(r.geojson) for r in geojson.Reveal.of(walked, s).encode(requests).collect()} for s in (0.0, 80.0))
    assert len(exact) == 21 * 4 and exact.keys() == thinned.keys()
    for key, lines in exact.items():
        assert [x[-1] for x in lines] == [x[-1] for x in thinned[key]]
        assert sum(map(len, thinned[key])) <= sum(map(len, lines))
    for k in (0.0, 0.3, 0.65, 1.0):
        for r in geojson.encode(walked, k).collect():
            if r.track_id != "point":
                assert coordinates(r.geojson) == exact[r.track_id, k], (r.track_id, k)


def test_a_winding_track_is_revealed_by_its_whole_length(spark):
    """It winds first and then runs straight: half of its length is passed long before half of its straight part."""
    rows = [("w", 0, i, 45.0 + (0.0005 if i % 2 else 0.0), 7.0 + i * 1e-5, None, None, None) for i in range(400)]
    rows += [("w", 0, 400 + i, 45.0, 7.004 + i * 0.002, None, None, None) for i in range(1, 60)]
    points = spark.createDataFrame(rows, POINTS)
    [end] = {tuple(coordinates(geojson.encode(points, 0.5).first().geojson)[0][-1])}
    assert tuple(coordinates(geojson.encode_thinned(points, 0.5, 150.0).first().geojson)[0][-1]) == end


def test_the_last_sample_is_the_last_points(spark):
    """However the sums of the lengths are rounded: the point before has no height, so that its stretch has none either."""
    rng = random.Random(5)
    rows = [
        (str(t), s, i, 45 + 0.1 * s + 0.0005 * i + rng.random() * 1e-4, 7 + rng.random() * 1e-3, 800.0 + t if (s, i) == (2, 5) else None, None, None)
        for t in range(200) for s in range(3) for i in range(6)
    ]
    last = profile.profile(spark.createDataFrame(rows, POINTS)).filter("sample_idx = 239").collect()
    assert {r.track_id: r.ele for r in last} == {str(t): 800.0 + t for t in range(200)}


def test_new_points_are_numbered_before_they_are_made(walked, small_chunks):
    """None of them is shuffled or sorted, and numbers run on from chunk to chunk of a segment."""
    dense = transforms.densify(walked, 5.0)
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert not {"Exchange", "Sort", "Window"} & set(plan[: plan.index("Generate")].split())
    numbers = {}
    for r in dense.collect():
        numbers.setdefault((r.track_id, r.segment_idx), []).append(r.point_idx)
    assert len(numbers) == 6 and all(sorted(n) == list(range(len(n))) for n in numbers.values())
    assert tracks.legs(dense).agg(F.max("leg_m")).first()[0] <= 5.0 + 1e-6


def test_reveals_by_several_spacings_share_one_preparation(walked, small_chunks):
    """Each gives what it gives alone, from one pass over the points, and no request prepares them again."""
    asked = walked.select("track_id").distinct().withColumn("fraction", F.explode(F.array(F.lit(0.3), F.lit(1.0))))
    together = geojson.Reveal.of(walked, 0.0, 80.0, 30.0)
    both = {(r.spacing_m, r.track_id, r.fraction, r.geojson) for r in together.encode(asked).collect()}
    alone = {(s, r.track_id, r.fraction, r.geojson) for s in (0.0, 80.0, 30.0) for r in geojson.Reveal.of(walked, s).encode(asked).collect()}
    assert both == alone and len(both) == 4 * 2 * 3
    assert "MapInArrow" not in together.encode(asked)._jdf.queryExecution().executedPlan().toString()


def test_the_last_sample_may_decide_the_dominant_band(spark):
    """Of 239 stretches 120 are UNKNOWN, the last among them, and 119 FLAT: heights begin below the middle and end before the last point."""
    rng = random.Random(7)
    rows = []
    for t in range(200):
        for s in range(3):
            for i, at in enumerate((0, 1, 2, 2.374, 4, 5)):
                known = (1, 3) <= (s, i) < (2, 5)
                rows.append((str(t), s, i, 45 + 0.1 * s + 0.0005 * at + rng.random() * 1e-6, 7.0, 800.0 if known else None, None, None))
    bands = tracks.dominant_bands(tracks.band_fractions(profile.profile(spark.createDataFrame(rows, POINTS)))).collect()
    assert {r.track_id: r.dominant_band for r in bands} == {str(t): "UNKNOWN" for t in range(200)}
