"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: steps that build on each other keep no lineage, and a lost executor
    costs no earlier step."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
