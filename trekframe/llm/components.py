"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _print_of(edges: DataFrame) -> tuple:
    """Tells sets of edges apart; exclusive or can't overflow, however many edges there are."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("g")).first()
    return row["n"], row["h"], row["g"]


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links (a, b): the smallest id that it reaches.

    Every step is a minimum by node and a join back; the number of steps grows with the logarithm of the longest
    path.  Each step's edges are a written table, so a lost executor costs one step at most.  Links of an id with
    itself and null ids count for nothing.
    """
    first, second = links.columns[:2]
    edges = links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v"))
    edges = written(edges.filter("u <> v").distinct(), "edges")
    before = _print_of(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = least.select("u", F.col("m").alias("v"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = [edges, large]
        edges = written(kept.union(small).distinct(), "edges")
        drop(*done)
        now = _print_of(edges)
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(heads)
