"""Best-fit packing of token pieces into sequences: minimum bin slack over the lengths at hand.

For each bin a bitset subset-sum programme over the available lengths (with their multiplicities) finds the fullest
feasible combination around the longest piece left, which is removed.  As the programme sees lengths and not rows, it runs over the histogram of
lengths: ``max_tokens`` counts at most, however many documents there are.  A combination is taken as often as its
lengths last, so every round uses up a length and there are at most ``max_tokens`` rounds.  Rows then find their
sequence and place from their rank among the pieces of the same length.

Defined results: null and empty texts are pieces of their end id alone; repeated rows are packed once each; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_rank, written
from .tokens import token_pieces

TOKENIZER = "word_bpe_49k.json"


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, times) of a fullest combination that holds the longest piece left: a bitset of reachable sums for each
    length from the longest, then the way back.  Multiplicities are split into powers of two.

    Without the longest piece in every bin, early bins use up the short pieces and long ones are left to bins of their
    own.
    """
    seed = max(counts)
    room = capacity - seed
    reach, trail = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((k for k in counts if k <= room), reverse=True):
        left, step = min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            take = min(step, left)
            trail.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rows, times a bin, first bin, offset in the bin) that packs all counted pieces."""
    counts, taken = {k: v for k, v in counts.items() if v > 0}, dict.fromkeys(counts, 0)
    out, bins = [], 0
    while counts:
        used = fullest(counts, capacity)
        repeats = min(counts[length] // times for length, times in used)
        offset = 0
        for length, times in used:
            out.append((length, taken[length], repeats * times, times, bins, offset))
            taken[length] += repeats * times
            counts[length] -= repeats * times
            offset += length * times
            if not counts[length]:
                del counts[length]
        bins += repeats
    return out


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """pieces (a written table with length, doc_id, piece) with sequence_id and offset by a plan of rank intervals."""
    spark = pieces.sparkSession
    steps = spark.createDataFrame(
        plan, "length long, _first long, _rows long, _times long, _bin long, _offset long"
    )
    by_length = steps.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_first", "_rows", "_times", "_bin", "_offset"))).alias("_steps")
    )
    ranked = class_rank(pieces, ["length"], ["doc_id", "piece"])
    step = F.filter("_steps", lambda s: (F.col("rank") >= s["_first"]) & (F.col("rank") < s["_first"] + s["_rows"]))[0]
    place_in = F.col("rank") - F.col("_s._first")
    return (
        ranked.join(F.broadcast(by_length), "length")  # a row for each length up to the capacity
        .withColumn("_s", step)
        .withColumn("sequence_id", F.col("_s._bin") + F.floor(place_in / F.col("_s._times")).cast("long"))
        .withColumn("offset", F.col("_s._offset") + F.pmod(place_in, F.col("_s._times")) * F.col("length"))
        .drop("_s", "_steps", "rank")
    )


def length_counts(pieces: DataFrame) -> dict[int, int]:
    """The histogram of lengths; bounded by the capacity."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(
    documents: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, id_bytes: int = 0
) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; with id_bytes 2 or 4 also its token ids."""
    pieces = written(token_pieces(documents, tokenizer, max_tokens, end_id, id_bytes), "pack-pieces")
    placed = place(pieces, slack_plan(length_counts(pieces), max_tokens))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if id_bytes else []))


def op2_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(documents, public_tokenizers.path(TOKENIZER))
