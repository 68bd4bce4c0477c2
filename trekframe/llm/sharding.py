"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key's place on the ring is a hash of its key columns.  Every shard owns many virtual nodes; a key belongs to the
first virtual node clockwise.  No shard takes more rows than its bound; the keys of an arc that find it full continue
clockwise to the next shard with room.  With slack 0 the bounds add up to the number of rows, so the counts of two
shards differ by one at most.

Only counts by ring cell reach the driver (``2 ** CELL_BITS`` numbers, whatever the number of rows).  From them the
whole outcome follows as rank intervals by cell, so each row finds its shard and slot from its rank in its cell: one
shuffle of the key columns, no iteration over rows.

Defined results: null or empty texts and null keys are hashed like any value; repeated rows are keys of their own and
take slots of their own; an empty table gives an empty result; other columns are carried along unchanged unless they
have the name of an output column, which is then replaced.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CELL_BITS = 15


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(n_shards: int, replicas: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; of two on one cell the smaller shard keeps it."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(replicas):
            cell = _mixed(_mixed(shard) ^ (replica * 0x9FB21C651E98DF25 & (2**64 - 1))) >> (64 - cell_bits)
            points[cell] = min(shard, points.get(cell, shard))
    return sorted(points.items())


def bounds(rows: int, n_shards: int, slack: float) -> list[int]:
    """Most rows of each shard.  Without slack they add up to rows."""
    if slack > 0:
        return [-int(-(rows * (1 + slack)) // n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def assignment(
    counts: dict[int, int], n_shards: int, replicas: int, slack: float
) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rows, shard, first slot) for counts of keys by ring cell."""
    points = ring(n_shards, replicas)
    cells = [c for c, _ in points]
    room, used = bounds(sum(counts.values()), n_shards, slack), [0] * n_shards
    onward = list(range(len(points) + 1))  # the next virtual node whose shard may have room

    def next_open(i: int) -> int:
        path = []
        while True:
            i %= len(points)
            if onward[i] != i:
                path.append(i)
                i = onward[i]
            elif room[points[i][1]] == 0:
                path.append(i)
                onward[i] = i = (i + 1) % len(points)
            else:
                for p in path:
                    onward[p] = i
                return i

    out, waiting = [], []

    def place(cell: int, rank: int, n: int, shard: int) -> int:
        took = min(n, room[shard])
        if took:
            out.append((cell, rank, took, shard, used[shard]))
            room[shard] -= took
            used[shard] += took
        return took

    for cell in sorted(counts):
        at = bisect_left(cells, cell) % len(points)
        took = place(cell, 0, counts[cell], points[at][1])
        if took < counts[cell]:
            waiting.append((cell, took, counts[cell] - took, at))
    for cell, rank, n, at in waiting:
        while n:
            at = next_open(at)
            took = place(cell, rank, n, points[at][1])
            rank, n = rank + took, n - took
    return out


def ring_hash(keys: list[str]) -> Column:
    return F.xxhash64(F.lit("ring"), *keys)


def shard(
    rows: DataFrame, keys: list[str], n_shards: int = 40, replicas: int = 256, slack: float = 0.0
) -> DataFrame:
    """rows with columns shard (int) and slot (long, gapless from 0 in each shard).

    keys: columns whose hash is a row's place on the ring; they should tell rows apart, as the rows of one key are
    ranked in one task.  slack: 0 for equal counts, else the part by which a shard
    may exceed the mean; more slack means fewer rows that move when the number of shards changes.
    """
    spark: SparkSession = rows.sparkSession
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    placed = rows.select(
        *kept,
        ring_hash(keys).alias("_hash"),
    ).withColumn("_cell", F.shiftrightunsigned("_hash", 64 - CELL_BITS).cast("int"))
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    plan = spark.createDataFrame(
        assignment(counts, n_shards, replicas, slack),
        "_cell int, _first long, _n long, shard int, _slot long",
    )
    ranked = placed.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", *keys)) - F.lit(1)
    )
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    return (
        ranked.join(plan, "_cell")
        .filter(inside)
        .select(*kept, "shard", (F.col("_slot") + F.col("_rank") - F.col("_first")).alias("slot"))
    )


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes sharded rows as one folder for each shard, in the order of their slots, over several files a shard."""
    (
        rows.repartition(F.col("shard"), F.shiftright("slot", 17))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def document_shards(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """The digest of sharding documents by id and content: equal row counts, see op1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = written(
        documents.select(
            F.col("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        ),
        "shard-keys",
    )
    out = shard(light, ["doc_id", "text_crc32"], n_shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards; law: rows."""
    return document_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
