import math
import random

import pytest
from pyspark.sql import functions as F

from trekframe.functions import geodesy as geo
from trekframe.functions import scalars as sc


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_published_lengths():
    d, first, last = geo.inverse_arrays([0.0, 0.0, 5.0], [0.0, 0.0, 6.0], [0.0, 90.0, 5.0], [1.0, 0.0, 6.0])
    assert d[0] == pytest.approx(111319.4908, abs=0.01) and d[1] == pytest.approx(10001965.7293, abs=0.5)
    assert (d[2], first[2], last[2]) == (0, 0, 0) and first[0] == pytest.approx(90)


@pytest.mark.parametrize("metres", [1.0, 1e3, 25e3, 250e3])
def test_there_and_back(metres):
    bearings = [i * 45.0 for i in range(8)]
    lat, lon = geo.direct_arrays([46.5] * 8, [7.9] * 8, bearings, [metres] * 8)
    d, first, _ = geo.inverse_arrays([46.5] * 8, [7.9] * 8, lat, lon)
    assert d == pytest.approx([metres] * 8, abs=metres * 1e-8 + 1e-6)
    turn = [abs((a - b + 180) % 360 - 180) for a, b in zip(first, bearings, strict=True)]
    assert max(turn) < max(1e-6, 1e-3 / metres)


def test_odd_places():
    d, first, _ = geo.inverse_arrays([0, 10, 91, math.nan, 10], [0, 179.9, 0, 0, 20], [0.3, 10, 0, 0, 10], [179.7, -179.9, 0, 0, 380])
    assert 1.9e7 < d[0] < 2.01e7  # nearly opposite: the sphere
    assert d[1] == pytest.approx(21928, rel=0.01)  # over the antimeridian
    assert math.isnan(d[2]) and math.isnan(d[3]) and math.isnan(d[4])


def test_columns_give_null_for_what_cannot_be(spark):
    rows = spark.createDataFrame([(46.0, 7.0, 46.0, 7.1), (None, 7.0, 46.0, 7.0), (95.0, 7.0, 46.0, 7.0)], "a double, b double, c double, d double")
    found = [r[0] for r in rows.select(geo.distance("a", "b", "c", "d")).collect()]
    assert found[0] == pytest.approx(7750, rel=0.01) and found[1:] == [None, None]
    there = rows.select(geo.destination(F.col("a"), F.col("b"), F.lit(90.0), F.lit(-1.0)).alias("p")).first()
    assert there.p is None or there.p.lat is None


def test_angles(spark):
    x = lambda v: F.lit(float(v))
    row = one(
        spark, a=geo.normalize_degrees(x(-10)), b=geo.normalize_longitude(x(180)), c=geo.normalize_longitude(x(-180)), d=geo.normalize_longitude_delta(x(-180)),
        e=sc.shortest_delta(x(350), x(10)), f=sc.shortest_delta(x(10), x(190)), g=sc.lerp_angle(x(350), x(10), x(0.5)), h=geo.normalize_longitude(x(541)),
    )
    assert tuple(row) == (350, 180, 180, -180, 20, 180, 0, -179)


def test_interpolation_is_exact_at_the_ends(spark):
    p = [F.lit(v) for v in (46.0, 7.0, 46.5, 8.0)]
    row = one(spark, a=geo.interpolate(*p, F.lit(0.0)), b=geo.interpolate(*p, F.lit(1.0)), c=geo.interpolate(*p, F.lit(7.0)), m=geo.interpolate(*p, F.lit(0.5)))
    assert tuple(row.a) == (46.0, 7.0) and tuple(row.b) == tuple(row.c) == (46.5, 8.0) and 46.2 < row.m.lat < 46.3


def test_local_metric_is_close_to_the_ellipsoid(spark):
    rng = random.Random(3)
    pairs = [(la := rng.uniform(-60, 60), lo := rng.uniform(-170, 170), la + rng.uniform(-0.01, 0.01), lo + rng.uniform(-0.01, 0.01)) for _ in range(50)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    columns = [F.col(x) for x in "abcd"]
    for r in rows.select(geo.local_distance(*columns).alias("x"), geo.distance(*columns).alias("y")).collect():
        assert r.x == pytest.approx(r.y, rel=1e-4, abs=0.01)
    dev = geo.local_deviation((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(0.5), F.lit(2.0)))
    assert one(spark, v=dev).v.fraction == 1
    still = geo.local_deviation((F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)))
    assert one(spark, v=still).v.fraction == 0


def test_bands_and_difficulty(spark):
    grades = [-20.0, -15.0, -7.0, -3.0, 2.9, 3.0, 7.0, 15.0, None, math.nan, math.inf]
    rows = spark.createDataFrame([(g,) for g in grades], "g double")
    assert [r[0] for r in rows.select(sc.gradient_band(F.col("g"))).collect()] == [
        "STEEP_DESCENT", "DESCENT", "GENTLE_DESCENT", "FLAT", "FLAT", "GENTLE_CLIMB", "CLIMB", "STEEP_CLIMB", "UNKNOWN", "UNKNOWN", "UNKNOWN",
    ]
    cases = spark.createDataFrame([(5e3, 100.0), (12e3, 300.0), (25e3, 900.0), (42e3, 2000.0), (80e3, 5000.0)], "m double, g double")
    assert [r[0] for r in cases.select(sc.difficulty(F.col("m"), F.col("g"))).collect()] == ["EASY", "MODERATE", "HARD", "SEVERE", "EXTREME"]


def test_texts(spark):
    x = lambda v: F.lit(v).cast("double")
    row = one(
        spark, a=sc.format_distance(x(400)), b=sc.format_distance(x(12345)), c=sc.format_distance(x(100), True), d=sc.format_distance(x(3218.688), True),
        e=sc.format_distance(x(None)), f=sc.format_duration(x(13200)), g=sc.format_duration(x(2400)), h=sc.format_gradient(x(7.6)), i=sc.format_elevation(x(1000), True),
        j=sc.band_label(F.lit("STEEP_CLIMB")), k=sc.band_color(F.lit("UNKNOWN")), l=sc.difficulty_label(F.lit("HARD")), m=sc.format_elevation(x(math.nan)),
    )
    dash = sc.MISSING
    assert tuple(row) == ("400 m", "12.3 km", "328 ft", "2.00 mi", dash, "3h 40m", "40m", "+8%", "3,281 ft", "Steep climb", "#9AA0A6", "Hard", dash)


def test_texts_round_as_printf_does(spark):
    """Ties to even and near ties by the double's exact value; Python's % is C's printf."""
    values = [0.5, 1.5, 816.5, 817.5, 999.5, 1250.0, 1350.0, 12250.0, 12350.0, 12450.0, 2716.23, 1e6 + 50.0, 0.3048 * 352.5, 1609.344 * 1.125, 1609.344 * 2.375, 1609.344 * 2.675, 1609.344 * 1.005]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    found = rows.select("v", sc.format_distance(v), sc.format_distance(v, True), sc.format_elevation(v), sc.format_elevation(v, True), sc.format_gradient(v)).collect()
    for x, *texts in found:
        near, far = "%.0f m" % x if x < 1000 else "%.1f km" % (x / 1000), "%.0f ft" % (x / 0.3048) if x / 1609.344 < 0.1 else "%.2f mi" % (x / 1609.344)
        assert [t.replace(",", "") for t in texts] == [near, far, "%.0f m" % x, "%.0f ft" % (x / 0.3048), "%+.0f%%" % x], x


def test_times(spark):
    texts = ["2024-05-01T10:00:00Z", "2024-05-01T10:00:00", "2024-05-01T12:00:00+02:00", "2024-05-01T10:00:00.250Z", "soon", None, "2024-13-01T00:00:00Z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in rows.select(sc.parse_time(F.col("t"))).collect()]
    base = 1714557600000
    assert found == [base, base, base, base + 250, None, None, None]
    assert one(spark, a=sc.format_time(F.lit(base)), b=sc.format_time(F.lit(base + 250))).asDict() == {"a": texts[0], "b": texts[3]}
