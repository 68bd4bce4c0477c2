"""Elevation profiles: evenly spaced samples along the walking axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gradient_band
from .tracks import in_chunk, on_axis


def profile(points: DataFrame, samples: int = 240) -> DataFrame:
    """track_id, sample_idx, distance_m, ele, is_across_gap, gradient_pct.

    Knots are the points at which the walking distance grows.  A knot knows the next one, so the samples between them
    come from exploding their numbers: no join.  Heights are linear between knots, or the earlier one's where either
    is missing; the gradient is that of the arriving stretch, null after a gap.  A track without length has one sample.
    """
    if samples < 2:
        raise ValueError("a profile needs two samples at least")
    # A knot knows the next one of its chunk, and a chunk's last knot the first of the chunks that follow.
    knots = on_axis(points).filter("_opening or leg_m > 0")
    knots = knots.withColumn("_next", F.coalesce(F.lead(F.struct(F.col("cum_end_m").alias("d"), "ele")).over(in_chunk()), "_later"))
    knots = knots.select(
        "track_id", "segment_idx", "ele", F.col("cum_end_m").alias("d"), F.col("_next.d").alias("next_d"), F.col("_next.ele").alias("next_ele"), F.col("total_m").alias("total")
    )
    last = samples - 1
    step = F.col("total") / last
    first_k = F.greatest(F.lit(0), F.floor(F.col("d") / step).cast("int") - 1)
    last_k = F.when(F.col("next_d").isNull(), F.lit(last)).otherwise(F.least(F.lit(last), F.ceil(F.col("next_d") / step).cast("int") + 1))
    numbers = F.when(F.col("total") > 0, F.sequence(first_k, last_k)).otherwise(F.array(F.lit(0)))
    at = knots.withColumn("sample_idx", F.explode(numbers)).withColumn(
        "distance_m", F.when(F.col("sample_idx") == last, F.col("total")).otherwise(F.col("total") * F.col("sample_idx") / last)
    )
    # The last sample is the last knot's: its distance and the track's length are summed in different orders.
    inside = (F.col("distance_m") >= F.col("d")) & (F.col("next_d").isNull() | (F.col("distance_m") < F.col("next_d")))
    at = at.filter(F.when(F.col("sample_idx") == last, F.col("next_d").isNull()).otherwise(inside))
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("distance_m") - F.col("d")) / (F.col("next_d") - F.col("d"))))
    linear = F.col("ele") + (F.col("next_ele") - F.col("ele")) * along
    order = Window.partitionBy("track_id").orderBy("sample_idx")
    across = F.coalesce(F.lag("segment_idx").over(order) != F.col("segment_idx"), F.lit(False))
    sampled = at.withColumn("_ele", F.coalesce(linear, F.col("ele"))).withColumn("is_across_gap", across)
    run = F.col("distance_m") - F.lag("distance_m").over(order)
    gradient = F.when(~F.col("is_across_gap") & (run > 0), (F.col("_ele") - F.lag("_ele").over(order)) / run * 100.0)
    return sampled.select("track_id", "sample_idx", "distance_m", F.col("_ele").alias("ele"), "is_across_gap", gradient.alias("gradient_pct"))


def profile_header(samples: DataFrame) -> DataFrame:
    """One row a track: whether there are heights and gaps, and their range."""
    return samples.groupBy("track_id").agg(
        F.max("distance_m").alias("total_m"), F.bool_or(F.col("ele").isNotNull()).alias("has_elevation"),
        F.bool_or("is_across_gap").alias("has_gaps"), F.min("ele").alias("min_ele"), F.max("ele").alias("max_ele"),
    )


def filled(samples: DataFrame) -> DataFrame:
    """samples with chart_ele: a missing height is the next known one, else the last known one, else 0."""
    order = Window.partitionBy("track_id").orderBy("sample_idx")
    later = F.first("ele", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    earlier = F.last("ele", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("chart_ele", F.coalesce(later, earlier, F.lit(0.0)))


def band_runs(samples: DataFrame) -> DataFrame:
    """track_id, run_idx, band, first_idx, last_idx: the longest stretches of one gradient band."""
    order = Window.partitionBy("track_id").orderBy("sample_idx")
    named = samples.withColumn("band", gradient_band(F.col("gradient_pct")))
    starts = F.when(F.lag("band").over(order) == F.col("band"), 0).otherwise(1)
    numbered = named.withColumn("_new", starts).withColumn("run_idx", F.sum("_new").over(order) - 1)
    return numbered.groupBy("track_id", "run_idx", "band").agg(F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"))


def index_at(fraction: Column, last: Column) -> Column:
    """The sample next to a fraction of a chart's width."""
    return F.greatest(F.lit(0), F.least(last, F.floor(fraction * last + 0.5))).cast("int")
