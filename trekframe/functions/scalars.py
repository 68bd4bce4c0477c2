"""Scalar rules of hiking: pace, gradient bands, difficulty, angles, easing, text formats and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, label, colour and upper bound (exclusive, percent) of the gradient bands.
BANDS = [
    ("STEEP_DESCENT", "Steep descent", "#2C7BB6", -15.0),
    ("DESCENT", "Descent", "#6FAEDC", -7.0),
    ("GENTLE_DESCENT", "Gentle descent", "#B7D6EA", -3.0),
    ("FLAT", "Flat", "#C2C7CC", 3.0),
    ("GENTLE_CLIMB", "Gentle climb", "#F6C177", 7.0),
    ("CLIMB", "Climb", "#EF8534", 15.0),
    ("STEEP_CLIMB", "Steep climb", "#D7191C", float("inf")),
    ("UNKNOWN", "No elevation data", "#9AA0A6", float("nan")),
]
#: Name and upper bound (exclusive) of effort, in kilometres plus hundreds of metres climbed.
DIFFICULTIES = [("EASY", 10.0), ("MODERATE", 20.0), ("HARD", 40.0), ("SEVERE", 70.0), ("EXTREME", float("inf"))]
METRES_PER_MILE, METRES_PER_FOOT = 1609.344, 0.3048


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tobler_kmh(grade: Column) -> Column:
    """Walking speed after Tobler for a grade as a fraction; null for a grade that is not finite."""
    return F.greatest(F.lit(0.05), 6.0 * F.exp(-3.5 * F.abs(finite(grade) + 0.05)))


def hiking_seconds(metres: Column, climb: Column) -> Column:
    """Time for a stretch with a change of height; a missing change counts as flat, no distance takes no time."""
    rise = F.coalesce(finite(climb), F.lit(0.0))
    return F.when(metres <= 0, F.lit(0.0)).otherwise(metres / (tobler_kmh(rise / F.nullif(metres, F.lit(0.0))) / 3.6))


def _step(x: Column, steps: list[tuple[str, float]]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, upper in steps[:-1]:
        out = out.when(x < upper, F.lit(name))
    return out.otherwise(F.lit(steps[-1][0]))


def gradient_band(percent: Column) -> Column:
    """The band of a gradient; UNKNOWN for a missing one or one that is not finite."""
    return F.when(finite(percent).isNull(), F.lit("UNKNOWN")).otherwise(_step(percent, [(name, upper) for name, _, _, upper in BANDS[:-1]]))


def difficulty(metres: Column, gain: Column) -> Column:
    return _step(metres / 1000.0 + gain / 100.0, DIFFICULTIES)


def pseudo_random(seed: Column, index: Column) -> Column:
    value = F.sin(seed * 12.9898 + index * 78.233) * 43758.5453
    return value - F.floor(value)


def catmull_rom(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    square = (2.0 * p0 - 5.0 * p1 + 4.0 * p2 - p3) * t * t
    return 0.5 * (2.0 * p1 + (p2 - p0) * t + square + (3.0 * p1 - p0 - 3.0 * p2 + p3) * t * t * t)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def shortest_delta(a: Column, b: Column) -> Column:
    """The turn from angle a to b, in (-180, 180]."""
    d = (b - a) % 360.0
    return F.when(d > 180, d - 360.0).when(d <= -180, d + 360.0).otherwise(d)


def _unit(t: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def lerp_angle(a: Column, b: Column, t: Column) -> Column:
    return F.pmod(a + shortest_delta(a, b) * _unit(t), F.lit(360.0))


def ease_out_cubic(t: Column) -> Column:
    return 1.0 - F.pow(1.0 - _unit(t), F.lit(3.0))


def ease_in_out_cubic(t: Column) -> Column:
    c = _unit(t)
    return F.when(c < 0.5, 4.0 * F.pow(c, F.lit(3.0))).otherwise(1.0 - F.pow(2.0 - 2.0 * c, F.lit(3.0)) / 2.0)


MISSING = "\N{EM DASH}"


def _even(x: Column, places: int = 0) -> Column:
    """x to a number of places as C's printf rounds: by the double's exact value, and a tie to the even digit (Java's formatter
    takes the shortest digits and rounds ties up)."""
    if not places:
        return F.rint(x)
    scale = 10.0**places
    # The double in two halves whose products with the scale are exact, so that the signs of both sums are those of exact arithmetic.
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    lower, near = (x - upper) * scale, F.rint(x * scale)
    above, below = (upper * scale - near - 0.5) + lower, (upper * scale - near + 0.5) + lower
    odd = F.pmod(near, F.lit(2.0)) == 1
    return (near + F.when((above > 0) | (above == 0) & odd, 1.0).when((below < 0) | (below == 0) & odd, -1.0).otherwise(0.0)) / scale


def format_distance(metres: Column, miles: bool = False) -> Column:
    if miles:
        far = metres / METRES_PER_MILE
        shown = F.when(far < 0.1, F.format_string("%,.0f ft", _even(metres / METRES_PER_FOOT))).otherwise(F.format_string("%,.2f mi", _even(far, 2)))
    else:
        shown = F.when(metres < 1000, F.format_string("%,.0f m", _even(metres))).otherwise(F.format_string("%,.1f km", _even(metres / 1000.0, 1)))
    return F.when(finite(metres).isNull(), F.lit(MISSING)).otherwise(shown)


def format_elevation(metres: Column, feet: bool = False) -> Column:
    shown = F.format_string("%,.0f ft", _even(metres / METRES_PER_FOOT)) if feet else F.format_string("%,.0f m", _even(metres))
    return F.when(finite(metres).isNull(), F.lit(MISSING)).otherwise(shown)


def format_duration(seconds: Column) -> Column:
    """Whole minutes, as 3h 40m or 40m."""
    minutes = F.floor(seconds / 60.0)
    hours = F.floor(minutes / 60)
    short = F.format_string("%dm", minutes)
    long = F.format_string("%dh %dm", hours, minutes % 60)
    return F.when(finite(seconds).isNull(), F.lit(MISSING)).when(hours > 0, long).otherwise(short)


def format_gradient(percent: Column) -> Column:
    return F.when(finite(percent).isNull(), F.lit(MISSING)).otherwise(F.format_string("%+.0f%%", _even(percent)))


def _looked_up(name: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), name)


def band_label(band: Column) -> Column:
    return _looked_up(band, {name: label for name, label, _, _ in BANDS})


def band_color(band: Column) -> Column:
    return _looked_up(band, {name: color for name, _, color, _ in BANDS})


def difficulty_label(name: Column) -> Column:
    return F.initcap(name)


def parse_time(text: Column) -> Column:
    """Milliseconds since 1970 of an ISO date and time; without a zone it is UTC, anything else is null."""
    trimmed = F.trim(text)
    with_zone = trimmed.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d(:?\d\d)?)$")
    without = trimmed.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?$")
    zoned = F.when(with_zone, trimmed).when(without, F.concat(trimmed, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def format_time(millis: Column) -> Column:
    """ISO instant in UTC, with milliseconds only where there are some.  The session's time zone must be UTC."""
    at = F.timestamp_millis(millis)
    whole, part = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.pmod(millis, F.lit(1000))
    return F.when(part == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.format_string(".%03dZ", part)))


def format_clock(millis: Column, pattern: str = "HH:mm") -> Column:
    """A time of day in the session's zone, by an explicit pattern instead of a device's habits."""
    return F.date_format(F.timestamp_millis(millis), pattern)


def format_date(millis: Column, pattern: str = "d MMM yyyy") -> Column:
    return F.date_format(F.timestamp_millis(millis), pattern)
