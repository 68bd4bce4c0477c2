"""Splits: a track cut every so many metres of walking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import METRES_PER_MILE, gradient_band, hiking_seconds
from .tracks import located

KILOMETRE, MILE = 1000.0, METRES_PER_MILE
#: The tolerance at a cut, and the shortest split that counts.
EPSILON, LEAST_M = 1e-6, 1.0


def _commits(heights: np.ndarray, ref: float, threshold: float) -> tuple[np.ndarray, float]:
    """What heights in order add to a reference, and the reference after them (NaN: none).

    The reference moves to the next height that differs by more than the threshold, found a window at a time; a missing
    height clears it and the next known one sets it.
    """
    change, i = np.zeros(len(heights)), 0
    while i < len(heights):
        if math.isnan(ref):
            known = np.flatnonzero(~np.isnan(heights[i:]))
            if not len(known):
                break
            i += int(known[0])
            ref, i = heights[i], i + 1
            continue
        width = 32
        while i < len(heights):
            seen = heights[i : i + width]
            hits = np.flatnonzero(~(np.abs(seen - ref) <= threshold))
            if len(hits):
                i += int(hits[0])
                change[i] = 0.0 if math.isnan(heights[i]) else heights[i] - ref
                ref, i = heights[i], i + 1
                break
            i, width = i + len(seen), width * 4
    return change, ref


def committed(on_axis: DataFrame, threshold: float) -> DataFrame:
    """Located points with gain and loss that each leg commits: a missing height clears the reference, a segment's
    first height sets it, legs without length are passed over.  Rows flow by in order; only one state is held."""
    kept = [c for c in on_axis.columns if c not in ("gain", "loss")]

    def run(batches):
        ref = math.nan
        for batch in batches:
            heights = pc.fill_null(batch.column("ele"), math.nan).to_numpy(zero_copy_only=False)
            first = batch.column("prev_lat").is_null().to_numpy(zero_copy_only=False)
            walked = batch.column("leg_m").to_numpy(zero_copy_only=False) > 0
            change = np.zeros(len(first))
            starts = np.unique(np.append(np.flatnonzero(first), 0)).tolist() if len(first) else []
            for a, b in zip(starts, [*starts[1:], len(first)], strict=True):
                ref = heights[a] if first[a] else ref
                at = a + np.flatnonzero(walked[a:b])
                change[at], ref = _commits(heights[at], ref, threshold)
            columns = [*(batch.column(c) for c in kept), pa.array(np.maximum(change, 0.0)), pa.array(np.maximum(-change, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "gain", "loss"])

    ordered = on_axis.select(*kept).repartition("track_id").sortWithinPartitions("track_id", "segment_idx", "point_idx")
    grown = T.StructType([*ordered.schema.fields, T.StructField("gain", T.DoubleType()), T.StructField("loss", T.DoubleType())])
    return ordered.mapInArrow(run, grown)


def splits(points: DataFrame, length_m: float = KILOMETRE, threshold: float = 3.0, attribution: str = "proportional") -> DataFrame:
    """track_id, split_idx (from 1), distances, climb, heights, gradient, times and whether the split is partial.

    attribution: ``proportional`` shares a leg's climb among the splits it passes, so that climbs add up;
    ``first_piece`` gives only the first of them its share.
    """
    if length_m <= 0:
        raise ValueError("a split must have a length")
    if attribution not in ("proportional", "first_piece"):
        raise ValueError(f"unknown attribution {attribution!r}")
    walked = committed(located(points), threshold).filter("prev_lat is not null and leg_m > 0")
    first = F.floor((F.col("cum_start_m") + EPSILON) / length_m)
    last = F.greatest(first, F.floor((F.col("cum_end_m") - EPSILON) / length_m))
    pieces = walked.withColumn("_first", first).withColumn("_i", F.explode(F.sequence(first, last)))
    start = F.greatest("cum_start_m", F.col("_i") * F.lit(length_m))
    end = F.least("cum_end_m", (F.col("_i") + 1) * F.lit(length_m))
    pieces = pieces.withColumns({"_start": start, "_end": end}).withColumn("_share", (F.col("_end") - F.col("_start")) / F.col("leg_m"))
    counts = F.lit(True) if attribution == "proportional" else F.col("_i") == F.col("_first")
    rise = F.col("ele") - F.col("prev_ele")
    height = lambda at: F.col("prev_ele") + rise * (F.col(at) - F.col("cum_start_m")) / F.col("leg_m")
    of_leg = lambda c: F.sum(F.when(counts, F.col(c) * F.col("_share")).otherwise(0.0))
    sums = pieces.groupBy("track_id", "_i").agg(
        F.sum(F.col("_end") - F.col("_start")).alias("distance_m"),
        of_leg("gain").alias("gain_m"),
        of_leg("loss").alias("loss_m"),
        F.min_by(height("_start"), "_start").alias("start_ele"),
        F.max_by(height("_end"), "_end").alias("end_ele"),
        F.sum(hiking_seconds(F.col("_end") - F.col("_start"), rise * F.col("_share"))).alias("seconds"),
    )
    order = Window.partitionBy("track_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return sums.filter(F.col("distance_m") >= LEAST_M).select(
        "track_id",
        (F.col("_i") + 1).alias("split_idx"),
        (F.col("_i") * F.lit(length_m)).alias("start_m"),
        (F.col("_i") * F.lit(length_m) + F.col("distance_m")).alias("end_m"),
        "distance_m", "gain_m", "loss_m", "start_ele", "end_ele",
        ((F.col("end_ele") - F.col("start_ele")) / F.col("distance_m") * 100.0).alias("gradient_pct"),
        "seconds",
        F.sum("seconds").over(order).alias("cumulative_s"),
        (F.col("distance_m") < length_m - EPSILON).alias("is_partial"),
    )


def fastest(found: DataFrame) -> DataFrame:
    """track_id and split_idx of the quickest whole split; of equal ones the first."""
    pace = F.struct(F.col("seconds") / F.col("distance_m"), F.col("split_idx"))
    whole = found.filter("not is_partial and distance_m > 0 and seconds > 0")
    return whole.groupBy("track_id").agg(F.min_by("split_idx", pace).alias("split_idx"))


def split_table(found: DataFrame, start_ms: Column) -> DataFrame:
    """splits with arrival_ms, the clock at their ends after a start, and band, of their gradients."""
    arrival = start_ms + F.floor(F.col("cumulative_s") * 1000.0)
    return found.withColumns({"arrival_ms": arrival, "band": gradient_band(F.col("gradient_pct"))})
