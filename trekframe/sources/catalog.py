"""A library of routes: a table of summaries to list from, and the points by route."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import DIFFICULTIES
from ..operators.tracks import route_analysis
from ..schema import POINTS, ROUTES
from .gpx import write_gpx

DEFAULT_NAME = "Unnamed route"


def summaries(points: DataFrame, names: Column, created_at_ms: Column) -> DataFrame:
    """routes rows of tracks; names and times are columns over track_id.  A blank name becomes the default one."""
    stats = route_analysis(points)
    name = F.coalesce(F.nullif(F.trim(names), F.lit("")), F.lit(DEFAULT_NAME))
    return stats.select(
        F.col("track_id").alias("id"), name.alias("name"), created_at_ms.cast("long").alias("created_at_ms"), "distance_m", "gain_m", "loss_m", "point_count", "difficulty",
        F.col("walking_s"),
    )


def listed(routes: DataFrame) -> DataFrame:
    """The latest first; an unknown difficulty reads as MODERATE."""
    known = F.col("difficulty").isin([name for name, _ in DIFFICULTIES])
    return routes.withColumn("difficulty", F.when(known, F.col("difficulty")).otherwise("MODERATE")).orderBy(F.desc("created_at_ms"), "id")


class RouteLibrary:
    """Routes in a folder: ``routes`` holds summaries, ``points`` the points in buckets of their ids, so that reading one
    route reads one bucket.  A removal is a marker in ``removed``, so nothing is rewritten and a lost task loses nothing.
    Every save gives its tracks new ids, so the same track may be saved, removed and saved again."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _bucket(self, track_id: Column) -> Column:
        return F.pmod(F.xxhash64(track_id), F.lit(self.BUCKETS)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        full = f"{self.path}/{name}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(full)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(full)

    def save(self, points: DataFrame, names: Column, created_at_ms: Column) -> str:
        """Adds tracks; tracks without points cannot occur in a table of points.  Returns what the new ids end in: a
        track's is its track_id, ``-`` and this."""
        ending = self.new_id()
        routes = summaries(points, names, created_at_ms).withColumn("id", F.concat("id", F.lit(f"-{ending}")))
        saved = points.withColumn("track_id", F.concat("track_id", F.lit(f"-{ending}")))
        bucketed = saved.withColumn("bucket", self._bucket(F.col("track_id")))
        bucketed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/points")
        routes.write.mode("append").parquet(f"{self.path}/routes")
        return ending

    def list(self) -> DataFrame:
        gone = self._read("removed", "id string")
        return listed(self._read("routes", ROUTES).join(gone, "id", "left_anti"))

    def load(self, track_id: str) -> DataFrame:
        mine = self._read("points", f"{POINTS}, bucket int").filter(F.col("track_id") == track_id)
        bucket = self.spark.range(1).select(self._bucket(F.lit(track_id))).first()[0]
        return mine.filter(F.col("bucket") == bucket).drop("bucket").join(self._read("removed", "id string").select(F.col("id").alias("track_id")), "track_id", "left_anti")

    def gpx(self, track_id: str) -> DataFrame:
        """track_id and xml: a saved route as a GPX document with its name; no row where there is none."""
        named = self._read("routes", ROUTES).filter(F.col("id") == track_id)
        documents = named.select(F.col("id").alias("track_id"), "name", F.lit(None).cast("string").alias("description"))
        return write_gpx(self.load(track_id), documents)

    def delete(self, track_id: str) -> None:
        """Removing what is not there does nothing."""
        self.spark.createDataFrame([(track_id,)], "id string").write.mode("append").parquet(f"{self.path}/removed")

    @staticmethod
    def new_id() -> str:
        return str(uuid.uuid4())
