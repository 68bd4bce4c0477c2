"""From raw documents to packed sequences, in stages that are each written and read again.

What nulls, empty and long texts, repeated rows, empty tables and other columns give is said in trekframe/llm/stages.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trekframe.llm.common import written
from trekframe.llm.stages import STAGES

#: SQL cannot express language identification or packing; tests hold each stage to brute force on what the one before kept
#: (of language ID only what it must reject and must keep: text without letters, and with them).
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
