"""Word n-grams of texts as 64-bit hashes, and their counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, slices, word_hashes

#: Distinct grams that a task gathers before it hands their counts on.
HELD = 1 << 20


def gram_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first places of runs of so many words inside texts, and the runs' hashes."""
    n = max(len(words) - size + 1, 0)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    k = words[:n]
    for j in range(1, size):
        k = mix(k * np.uint64(31) + words[j : j + n])
    at = np.flatnonzero(text[:n] == text[len(words) - n :])
    return at, k[at]


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key (ascending); NaN where there is none."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


class Sums:
    """Counts by hash, merged whenever many have come together."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        found, counts = np.unique(keys, return_counts=True)
        self.keys.append(found), self.counts.append(counts)
        self.held += len(found)

    def take(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(self.counts)).astype(np.int64)
        self.__init__()
        return keys[counts >= least], counts[counts >= least]


def gram_counts(texts: DataFrame, least: dict[int, int], only=None) -> DataFrame:
    """size, key and n of the runs of words of texts, for the sizes named; a run is counted by the tasks that meet it so
    often at least (1: every run, in full).  only: a broadcast with an ascending array for some sizes: of those sizes
    these runs alone are counted.  Size 0 stands for all words: one key, 0."""

    def batch_of(size: int, keys: np.ndarray, counts: np.ndarray):
        sizes = pa.array(np.full(len(keys), size, dtype=np.int32))
        return pa.RecordBatch.from_arrays([sizes, pa.array(keys.view(np.int64)), pa.array(counts)], ["size", "key", "n"])

    def run(batches):
        sums = {size: Sums() for size in least}
        for batch in batches:
            texts = batch.column(0)
            for first, last in slices(texts, 2 << 20):
                words, starts = word_hashes(texts[first:last].to_pylist())
                for size, held in sums.items():
                    found = gram_hashes(words, starts, size)[1] if size else np.zeros(len(words), dtype=np.uint64)
                    if only is not None and size in only.value:
                        wanted = only.value[size]
                        found = found[~np.isnan(lookup(wanted, wanted, found))]
                    held.add(found)
                    if held.held > HELD:
                        yield batch_of(size, *held.take(least[size]))
        for size, held in sums.items():
            yield batch_of(size, *held.take(least[size]))

    counted = texts.select(F.col("text").cast("string")).mapInArrow(lean(run), "size int, key long, n long")
    return counted.groupBy("size", "key").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most so many runs of a size, the commonest, ascending by key, and their counts."""
    found = counts.filter(F.col("size") == size).select("key", "n").orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]
