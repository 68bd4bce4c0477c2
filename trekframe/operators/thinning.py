"""Thinning over chunks of segments: which points are kept when each must be a spacing further on than the last.

What a chunk keeps depends on how far the last kept point before it lies behind, and only up to the first point it keeps:
that is one of the few in its first spacing, and all later ones follow from it.  So a chunk is summarised by those
candidates with how far their last kept point lies behind the chunk's end, the distances behind are folded over the
chunks of a segment, and each chunk is then thinned apart.  Segments of one chunk need neither summary nor fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tracks
from .tracks import PART, on_axis

_KINDS = [pa.string(), pa.int32(), pa.int64()]


def _chain(run_m: np.ndarray, kept_at: float, spacing_m: float) -> Iterator[int]:
    """Places of the points kept after a distance, in order of distances run_m."""
    while (i := int(np.searchsorted(run_m, kept_at + spacing_m))) < len(run_m):
        yield i
        kept_at = run_m[i]


def candidates(lengths: np.ndarray, spacing_m: float) -> tuple[list[float], list[float]]:
    """Of the points that may be kept first: how far into the chunk each lies, and how far behind the chunk's end the last
    kept point is if it is.  lengths: of the legs that arrive at the points."""
    run_m = np.cumsum(lengths)
    end = min(int(np.searchsorted(run_m, spacing_m)) + 1, len(run_m))
    first = np.flatnonzero(np.diff(run_m[:end], prepend=0.0) > 0)
    behind: dict[int, float] = {}
    for i in reversed(first.tolist()):
        path, at = [], i
        for at in _chain(run_m, run_m[i], spacing_m):
            path.append(at)
            if at in behind:
                break
        behind[i] = behind[at] if path and at in behind else float(run_m[-1] - run_m[path[-1] if path else i])
        behind |= dict.fromkeys(path, behind[i])
    return run_m[first].tolist(), [behind[i] for i in first.tolist()]


def behind_end(at: list[float], then: list[float], length: float, behind: float, spacing_m: float) -> float:
    """How far the last kept point is behind the end of a chunk, by how far it was behind its start."""
    for run_m, out in zip(at, then, strict=True):
        if run_m >= spacing_m - behind:
            return out
    return behind + length


def _parts(batches, *columns: str) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The chunks of sorted rows with the values of some columns."""
    key, held = None, []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changes = np.zeros(n - 1, dtype=bool)
        for c in PART:
            changes |= pc.fill_null(pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]), False).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            found = tuple(batch.column(c)[a].as_py() for c in PART)
            if held and found != key:
                yield key, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            key = found
            held.append([v[a:b] for v in values])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held, strict=True)]


def _behind(placed: DataFrame, spacing_m: float) -> DataFrame:
    """The columns of PART and _behind of chunks that others of their segment go before."""
    chunks = placed.groupBy(*PART).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("track_id", "segment_idx").orderBy("_chunk")
    followed = chunks.select(*PART, F.lead("_chunk").over(order).alias("_then")).filter("_then is not null")
    rows = placed.join(followed, PART).select(*PART, "point_idx", "prev_lat", "leg_m", "_then")
    rows = rows.sortWithinPartitions(*PART, "point_idx")

    def summarised(batches):
        for key, (first, lengths, then) in _parts(batches, "prev_lat", "leg_m", "_then"):
            opens = bool(np.isnan(first[0]))
            at, out = candidates(lengths[1:] if opens else lengths, spacing_m) if len(lengths) > opens else ([], [])
            row = [*key, int(then[0]), opens, at, out, float(lengths.sum())]
            kinds = [*_KINDS, pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [*PART, "_then", "opens", "at", "out", "length"])

    schema = "track_id string, segment_idx int, _chunk long, _then long, opens boolean, at array<double>, out array<double>, length double"
    found = rows.mapInArrow(summarised, schema).repartition("track_id", "segment_idx").sortWithinPartitions(*PART)

    def folded(batches):
        behind = 0.0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                behind = behind_end(row["at"], row["out"], row["length"], 0.0 if row["opens"] else behind, spacing_m)
                out.append(behind)
            columns = [batch.column("track_id"), batch.column("segment_idx"), batch.column("_then"), pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*PART, "_behind"])

    return found.mapInArrow(folded, "track_id string, segment_idx int, _chunk long, _behind double")


def spaced(points: DataFrame, spacing_m: float) -> DataFrame:
    """tracks.on_axis of points with _kept: whether a point is its segment's first or a spacing after the last kept one."""
    return spaced_each(points, [spacing_m]).withColumnRenamed("_kept_0", "_kept")


def spaced_each(points: DataFrame, spacings_m: list[float]) -> DataFrame:
    """spaced() by several spacings in one pass: _kept_0, _kept_1 and so on.

    Whether any segment has more than one chunk is asked first, of one column of the points.
    """
    placed = on_axis(points)
    kept = {s: f"_kept_{i}" for i, s in enumerate(spacings_m)}
    if not any(spacings_m):
        return placed.withColumns({c: F.lit(True) for c in kept.values()})
    # Where every segment is one chunk, nothing is carried over.
    alone = points.filter(F.col("point_idx") >= tracks.CHUNK).isEmpty()
    behinds, carried = {s: f"_behind{c}" for s, c in kept.items()}, placed
    for s, c in behinds.items():
        none = alone or not s
        carried = carried.withColumn(c, F.lit(None).cast("double")) if none else carried.join(_behind(placed, s).withColumnRenamed("_behind", c), PART, "left")
    rows = carried.sortWithinPartitions(*PART, "point_idx")
    names = [c for c in rows.columns if c not in behinds.values()]

    def run(batches):
        key, behind = None, dict.fromkeys(kept, 0.0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            changes = np.zeros(n, dtype=bool)
            for c in PART:
                changes[1:] |= pc.fill_null(pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]), False).to_numpy(zero_copy_only=False)
            changes[0] = key != tuple(batch.column(c)[0].as_py() for c in PART)
            first = batch.column("prev_lat").is_null().to_numpy(zero_copy_only=False)
            lengths = batch.column("leg_m").to_numpy(zero_copy_only=False)
            carried = {s: batch.column(c).to_numpy(zero_copy_only=False) for s, c in behinds.items()}
            keep = {s: first.copy() if s else np.ones(n, dtype=bool) for s in kept}
            starts = np.unique(np.append(np.flatnonzero(changes), 0)).tolist()
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                run_m = np.cumsum(lengths[a:b])
                for s in filter(None, kept):
                    if changes[a]:
                        behind[s] = 0.0 if first[a] else float(carried[s][a])
                    kept_at = run_m[0] if first[a] else -behind[s]
                    for i in _chain(run_m, kept_at, s):
                        keep[s][a + i] = True
                        kept_at = run_m[i]
                    behind[s] = float(run_m[-1] - kept_at)
            key = tuple(batch.column(c)[n - 1].as_py() for c in PART)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, keep.values())], [*names, *kept.values()])

    schema = rows.drop(*behinds.values()).schema
    for c in kept.values():
        schema = schema.add(c, "boolean")
    return rows.mapInArrow(run, schema)
