"""Climb over chunks of tracks: what a stretch of heights does to a reference, as a summary that is small and exact.

A reference moves to a height that differs from it by more than a threshold.  What a chunk does depends only on the
reference that comes in, and only until it moves for the first time: from there on gain, loss and the reference that goes
out are fixed.  The first height that moves an incoming reference is a running maximum or minimum of the chunk, and once
a height is more than two thresholds from the chunk's first one, it moves every reference that the first has not moved.
So a summary is that short list of records, each with what follows it, and a track is folded over its summaries in order:
no task holds more than a chunk, and a track of any length is summarised by as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A record: the height, whether it is a maximum (else a minimum), and gain, loss and reference after moving to it.
RECORDS = "array<struct<height: double, up: boolean, gain: double, loss: double, ref: double>>"


def _next_move(heights: np.ndarray, i: int, threshold: float) -> int:
    """The first place after i whose height moves a reference at i; the number of heights if there is none."""
    at, width = i + 1, 32
    while at < len(heights):
        hits = np.flatnonzero(np.abs(heights[at : at + width] - heights[i]) > threshold)
        if len(hits):
            return at + int(hits[0])
        at, width = at + width, width * 4
    return len(heights)


def summary(heights: np.ndarray, threshold: float) -> list[tuple[float, bool, float, float, float]]:
    """The records of finite heights in order; the first height comes first, as both kinds."""
    if not len(heights):
        return []
    far = np.flatnonzero(np.abs(heights - heights[0]) > 2 * threshold)
    head = heights[: int(far[0]) + 1] if len(far) else heights
    highest, lowest = np.maximum.accumulate(head), np.minimum.accumulate(head)
    ups, downs = np.append(True, highest[1:] > highest[:-1]), np.append(True, lowest[1:] < lowest[:-1])
    after: dict[int, tuple[float, float, float]] = {}
    out = []
    for i in np.flatnonzero(ups | downs).tolist():
        chain, at = [], i
        while at not in after:
            then = _next_move(heights, at, threshold)
            if then == len(heights):
                after[at] = (0.0, 0.0, float(heights[at]))
                break
            chain.append((at, then))
            at = then
        for at, then in reversed(chain):
            (gain, loss, ref), step = after[then], float(heights[then] - heights[at])
            after[at] = (gain + max(0.0, step), loss + max(0.0, -step), ref)
        out += [(float(heights[i]), up, *after[i]) for up in (True, False) if (ups if up else downs)[i]]
    return out


def moved(records: list[tuple], ref: float | None, threshold: float) -> tuple[float, float, float | None]:
    """Gain, loss and the outgoing reference of a summary for an incoming one (None: there was no height yet)."""
    if not records:
        return 0.0, 0.0, ref
    if ref is None:
        ref = records[0][0]
    for height, up, gain, loss, then in records:
        step = height - ref
        if (step if up else -step) > threshold:
            return gain + max(0.0, step), loss + max(0.0, -step), then
    return 0.0, 0.0, ref


def _runs(batches, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Runs of rows with equal first columns, with the values of the column after them."""
    key, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(i) for i in range(keys)]
        changes = np.zeros(n - 1, dtype=bool)
        for c in columns:
            changes |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        values = batch.column(keys).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            found = tuple(c[a].as_py() for c in columns)
            if found != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = found, []
            held.append(values[a:b])
    if held:
        yield key, np.concatenate(held)


def summaries(dealt: DataFrame, part: list[str], threshold: float) -> DataFrame:
    """track_id, segment_idx, _chunk and records of dealt (the columns of part, point_idx, ele; partitioned by part)."""
    height = F.when(~F.isnan("ele") & (F.abs("ele") < float("inf")), F.col("ele"))
    rows = dealt.select(*part, "point_idx", height.cast("double").alias("_h")).filter("_h is not null")
    rows = rows.sortWithinPartitions(*part, "point_idx").select(*part, "_h")
    names = ["height", "up", "gain", "loss", "ref"]

    def run(batches):
        out: list[list] = [[] for _ in range(len(part) + 1)]
        for key, heights in _runs(batches, len(part)):
            for column, x in zip(out, (*key, [dict(zip(names, r, strict=True)) for r in summary(heights, threshold)]), strict=True):
                column.append(x)
            if len(out[0]) >= 4096:
                yield batch_of(out)
                out = [[] for _ in out]
        if out[0]:
            yield batch_of(out)

    def batch_of(columns):
        fields = [("height", pa.float64()), ("up", pa.bool_()), ("gain", pa.float64()), ("loss", pa.float64()), ("ref", pa.float64())]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.struct(fields))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*part, "records"])

    return rows.mapInArrow(run, f"track_id string, segment_idx int, _chunk long, records {RECORDS}")


def folded(found: DataFrame, threshold: float, gap_reset: bool) -> DataFrame:
    """track_id, gain_m and loss_m of summaries; gap_reset: every segment starts without a reference."""
    ordered = found.repartition("track_id").sortWithinPartitions("track_id", "segment_idx", "_chunk")

    def run(batches):
        started, track, segment, ref, gain, loss = False, None, None, None, 0.0, 0.0
        for batch in batches:
            out = []
            for name, part, records in zip(*(batch.column(c).to_pylist() for c in ("track_id", "segment_idx", "records")), strict=True):
                if not started or name != track:
                    if started:
                        out.append((track, gain, loss))
                    started, track, segment, ref, gain, loss = True, name, part, None, 0.0, 0.0
                if gap_reset and part != segment:
                    segment, ref = part, None
                up, down, ref = moved([tuple(r.values()) for r in records], ref, threshold)
                gain, loss = gain + up, loss + down
            if out:
                yield batch_of(out)
        if started:
            yield batch_of([(track, gain, loss)])

    def batch_of(rows):
        names, gains, losses = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(gains), pa.array(losses)], ["track_id", "gain_m", "loss_m"])

    return ordered.mapInArrow(run, "track_id string, gain_m double, loss_m double")
