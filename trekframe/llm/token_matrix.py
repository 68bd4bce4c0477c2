"""Token-id matrices: best-fit-decreasing packing with segment-tree capacity search.

Pieces of tokenised documents (overlong ones are cut without loss) are placed from the longest down, each in the bin
with the least room that still holds it; a segment tree over the rooms 0 to ``max_tokens`` finds it.  Pieces of one
length are alike, so the plan is made from the histogram of lengths, at most ``max_tokens`` counts, and says for ranks
of pieces in which bins and where they go.  Spark then brings the pieces of a bin together, a bounded group, and
writes a row of the matrices: padded ids, cumulative segment lengths, positions that restart at every segment, and
where each segment comes from.

Defined results: null and empty texts are segments of the end id alone; repeated rows are segments each; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, written
from .packing import TOKENIZER, length_counts, place
from .tokens import encoder, token_pieces


class CapacityTree:
    """Which rooms some bin has; finds the least room that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, room: int, present: bool) -> None:
        at = room + self.leaves
        self.any[at] = present
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def first_at_least(self, room: int) -> int:
        """The least room from ``room`` on that a bin has; -1: none."""
        at = room + self.leaves
        if self.any[at]:
            return room
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rows, times a bin, first bin, offset in the bin) that packs all counted pieces."""
    tree, held, out, bins = CapacityTree(capacity), defaultdict(list), [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n:
            if not held[room]:
                tree.mark(room, True)
            held[room].append((first, n))

    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.first_at_least(length)
            if room < 0:
                n = -(-left // (capacity // length))
                keep(capacity, bins, n)
                bins += n
                continue
            first, n = held[room].pop()
            if not held[room]:
                tree.mark(room, False)
            # A bin that has taken a piece has less room than its equals and takes the next one too.
            times = min(room // length, left)
            used = min(n, left // times)
            out.append((length, rank, used * times, times, first, capacity - room))
            rank, left = rank + used * times, left - used * times
            keep(room, first + used, n - used)
            keep(room - times * length, first, used)
    return out


def _matrix_rows(capacity: int, id_bytes: int, pad_id: int):
    kind = np.dtype(f"<u{id_bytes}")

    def row(segments):
        ids = [np.frombuffer(s[5], dtype=kind) for s in segments]
        lengths = np.array([len(x) for x in ids])
        ends = np.cumsum(lengths)
        line = np.full(capacity, pad_id, dtype=kind)
        positions = np.zeros(capacity, dtype=kind)
        line[: ends[-1]] = np.concatenate(ids)
        positions[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
        return (
            segments[0][0], int(ends[-1]), [0, *ends.tolist()], [s[2] for s in segments], [s[3] for s in segments],
            [s[4] for s in segments], line.tobytes(), positions.tobytes(),
        )

    names = ["row", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts", "ids", "positions"]

    def run(batches):
        segments: list[tuple] = []
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kinds = kinds or [
                pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(batch.schema.field(2).type), pa.list_(pa.int32()),
                pa.list_(pa.int64()), pa.binary(), pa.binary(),
            ]
            for segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segments and segments[0][0] != segment[0]:
                    out.append(row(segments))
                    segments = []
                    if len(out) == 256:
                        yield batch_of()
                        out = []
                segments.append(segment)
        if segments:
            out.append(row(segments))
        if out:
            yield batch_of()

    return run


def token_matrix(
    documents: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, pad_id: int = 0
) -> DataFrame:
    """A row of the matrices a bin: row, n_tokens, cu_seqlens, doc_ids, pieces, starts, ids and positions.

    ids and positions: max_tokens little-endian unsigned numbers of 16 bits, or 32 where the vocabulary or the width
    needs it; past n_tokens ids are pad_id and positions 0.  pieces and starts say which part of its document a
    segment is.
    """
    size = max(encoder(tokenizer).size, end_id + 1, pad_id + 1, max_tokens)
    id_bytes = 2 if size <= 1 << 16 else 4
    pieces = written(token_pieces(documents, tokenizer, max_tokens, end_id, id_bytes), "matrix-pieces")
    placed = place(pieces, best_fit_plan(length_counts(pieces), max_tokens))
    dealt = placed.select("sequence_id", "offset", "doc_id", "piece", "start", "ids").repartition("sequence_id")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, n_tokens long, cu_seqlens array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<long>, "
        "ids binary, positions binary"
    )
    return dealt.sortWithinPartitions("sequence_id", "offset").mapInArrow(lean(_matrix_rows(max_tokens, id_bytes, pad_id)), schema)


def write_matrices(matrix: DataFrame, path: str) -> None:
    """The matrices as Parquet files whose ids and positions are fixed-width binary rows, in the order of rows."""
    matrix.repartitionByRange("row").sortWithinPartitions("row").write.parquet(path)


def _digests(batches):
    for batch in batches:
        sums: list[list[int]] = [[], []]
        for n, *both in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "ids", "positions")), strict=True):
            for out, data in zip(sums, both, strict=True):
                width = len(data) // batch.column("width")[0].as_py()
                out.append(zlib.crc32(np.frombuffer(data, dtype=f"<u{width}")[:n].astype("<u4").tobytes()))
        columns = [batch.column(c) for c in ("row", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())],
            ["row", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts", "ids_crc32", "positions_crc32"],
        )


def op7_best_fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix rows of all documents, with checksums (of 32-bit numbers, without padding) in the place of contents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    matrix = token_matrix(documents, public_tokenizers.path(TOKENIZER), max_tokens=4096).withColumn("width", F.lit(4096))
    return matrix.mapInArrow(
        _digests,
        "row long, n_tokens long, cu_seqlens array<int>, doc_ids array<bigint>, pieces array<int>, starts array<long>, "
        "ids_crc32 long, positions_crc32 long",
    )
