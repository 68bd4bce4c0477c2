"""Tracks derived from an event stream, so that every operator runs on any events table.

Each user is a track; a pause of more than a day starts a segment; position, height and time are simple functions of
the events' order and numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dem import TILE

DAY_MS, START_MS = 86_400_000, 1_704_067_200_000


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points from events.parquet; only four of its columns are read."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    numbered = events.select(
        "user_id", "event_id", "value", "ts",
        (F.row_number().over(order) - 1).alias("rn"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.unix_millis(F.lag("ts").over(order).cast("timestamp")).alias("before"),
    )
    paused = F.when(F.col("ms") - F.col("before") > DAY_MS, 1).otherwise(0)
    with_segment = numbered.withColumn("segment_idx", F.sum(paused).over(order).cast("int"))
    inside = Window.partitionBy("user_id", "segment_idx").orderBy("ts", "event_id")
    user, event = F.col("user_id"), F.col("event_id")
    return with_segment.select(
        user.cast("string").alias("track_id"),
        "segment_idx",
        (F.row_number().over(inside) - 1).alias("point_idx"),
        (F.lit(45.0) + (user % 40) * F.lit(0.05) + F.col("rn") * F.lit(0.0005) + (event * 7 % 11) * F.lit(0.00002)).alias("lat"),
        (F.lit(6.0) + (user % 60) * F.lit(0.05) + (event * 13 % 17) * F.lit(0.00003)).alias("lon"),
        F.when(event % 13 != 0, F.lit(800.0) + F.col("value") * F.lit(0.1)).alias("ele"),
        (F.lit(START_MS) + F.expr(f"(ms - {START_MS}L) div 600")).alias("time_ms"),
        F.lit(None).cast("double").alias("hacc_m"),
    )


#: Tiles that a worker makes at a time; each has a quarter of a megabyte.
TILES_AT_ONCE = 32


def _surface(batches):
    down, across = np.divmod(np.arange(TILE * TILE, dtype=np.int64), TILE)
    for keys in batches:
        for at in range(0, len(keys), TILES_AT_ONCE):
            some = keys.iloc[at : at + TILES_AT_ONCE]
            made = [(32768 + 800 + ((i * TILE + across) * 3 + (j * TILE + down) * 7) % 97).astype(np.int32) * 256 for i, j in zip(some["x"], some["y"], strict=True)]
            yield some.assign(pixels=made)


def surface_tiles(needed: DataFrame) -> DataFrame:
    """dem_tiles of a terrain by formula, for distinct (zoom, x, y): 800 m and a ripple of 97 steps.

    Whole frames are mapped, so that no condition on pixels is moved in front of what finds the distinct tiles.
    """
    keys = needed.select("zoom", "x", "y")
    return keys.mapInPandas(_surface, T.StructType([*keys.schema.fields, T.StructField("pixels", T.ArrayType(T.IntegerType()))]))
