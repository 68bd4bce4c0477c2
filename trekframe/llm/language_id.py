"""Language identification by nearest centroid.

A text is the vector of its character 1-, 2- and 3-grams (lower case, all but letters as gaps), hashed to ``DIMENSIONS`` places, with logarithmic term
frequencies times inverse document frequencies, of length 1.  A language is several centroids, found by spherical
k-means over its training texts; a text has the language of the centroid with the largest cosine.  It is rejected if it
has no letter or lies further from its centroid than the language's texts do: its cosine is under ``REJECT_SHARE`` of
the smallest that a training text has with the centroids of its own language.

Centroids are fitted to at most ``SAMPLE`` texts of each language (a hashed sample of the labelled rows, whole texts);
every text is then compared with all centroids inside its own task, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; very long texts are counted in pieces
and wholly; rows with a null id are predicted but never learned from; an empty table, or one without training rows,
gives ``und`` for all its rows; other columns are ignored or carried along.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, lean, written

DIMENSIONS = 4096
#: Most training texts of a language, about.
SAMPLE = 800
CENTROIDS = 4
REJECT_SHARE = 0.5
_PIECE = 1 << 18


_letters: list[np.ndarray] = []


def letter_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters than letters is one space."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters[0][points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed character 1-, 2- or 3-gram of the text's letters and gaps occurs."""
    points = letter_points(text)
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    shift = np.uint32(32 - int(math.log2(DIMENSIONS)))
    for start in range(0, len(points), _PIECE):
        c = points[start : start + _PIECE + 2]
        n = min(_PIECE, len(points) - start)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        one = one * np.uint32(0x2C1B3C6D) + np.uint32(1)
        places = np.concatenate([one[:n], two[:n], three[:n]]) >> shift
        out += np.bincount(places, minlength=DIMENSIONS)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=-1, keepdims=True))
    return rows / np.maximum(length, 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of rows of counts."""
    return _unit(np.log1p(counts).astype(np.float32) * idf)


def spherical_kmeans(rows: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """k unit centroids; starts with the row next to the mean, then each time with the one furthest from those."""
    picks = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[picks[0]]
    while len(picks) < min(k, len(rows)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[picks[-1]])
    centroids = rows[picks]
    for _ in range(steps):
        own = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = _unit(sums)
    return centroids


class Model:
    """idf, centroids (a row each), their languages and their languages' least cosines."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], floors: np.ndarray):
        self.idf, self.centroids, self.languages, self.floors = idf, centroids, languages, floors

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        for text in texts:
            if not text or not self.languages or not has_letter(text):
                yield "und", 0.0, True
                continue
            cosines = self.centroids @ weighted(gram_counts(text), self.idf)
            best = int(cosines.argmax())
            score = float(min(1.0, max(0.0, cosines[best])))
            yield self.languages[best], score, score < self.floors[best]


def _sampled(training: DataFrame, most: int) -> DataFrame:
    """lang and text: a hashed sample of about ``most`` distinct texts of each language at most.

    Repeated texts of a language count once, whatever their ids, so neither one id nor one text can fill the sample or
    empty it.  Only hashes are shuffled until the sample is drawn.
    """
    keyed = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("_key", F.xxhash64("text"))
    keys = keyed.select("lang", "_key").distinct()
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64(F.lit("language"), "_key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.join(sizes, "lang").filter(draw < F.lit(float(most)) / F.col("_n")).select("lang", "_key")
    return keyed.join(F.broadcast(drawn), ["lang", "_key"]).groupBy("lang", "_key").agg(F.first("text").alias("text")).select("lang", "text")


def fit(documents: DataFrame, learns: Column, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """A model of the rows (doc_id, lang, text) for which ``learns`` holds."""
    training = documents.filter(learns & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def counted(batches):
        for batch in batches:
            languages, places, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    found = gram_counts(text)
                    at = np.flatnonzero(found)
                    languages.append(lang), places.append(at.astype(np.int32)), counts.append(found[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["lang", "places", "counts"],
            )

    rows = _sampled(training, sample)
    vectors = written(rows.mapInArrow(lean(counted), "lang string, places array<int>, counts array<int>"), "language-vectors")
    n = vectors.count()
    idf = np.full(DIMENSIONS, math.log(1 + n) + 1, dtype=np.float32)
    for row in vectors.select(F.explode("places").alias("place")).groupBy("place").count().collect():
        idf[row["place"]] = math.log((1 + n) / (1 + row["count"])) + 1

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), DIMENSIONS), dtype=np.int32)
        for i, (at, found) in enumerate(zip(group["places"], group["counts"], strict=True)):
            dense[i, at] = found
        order = sorted(range(len(dense)), key=lambda i: dense[i].tobytes())  # the rows' order of arrival must not matter
        vectors = weighted(dense[order], idf)
        found = spherical_kmeans(vectors, centroids)
        least = float((vectors @ found.T).max(axis=1).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": least, "centroid": list(found.astype(np.float64))})

    found = vectors.groupBy("lang").applyInPandas(clustered, "lang string, least double, centroid array<double>").collect()
    found.sort(key=lambda r: r["lang"])
    return Model(
        idf,
        np.array([r["centroid"] for r in found], dtype=np.float32).reshape(-1, DIMENSIONS),
        [r["lang"] for r in found],
        np.array([REJECT_SHARE * r["least"] for r in found]),
    )


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """documents with columns lang_pred, score and rejected; other columns of these names are replaced."""
    kept = [c for c in documents.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    held = documents.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions numbers

    def rows(batches):
        for batch in batches:
            found = list(held.value.predict(batch.column("_text").to_pylist()))
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "rejected"])

    named = documents.select(*kept, F.col("text").cast("string").alias("_text"))
    schema = named.drop("_text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return named.mapInArrow(lean(rows), schema)


def recognised(documents: DataFrame) -> DataFrame:
    """documents without those that identification rejects."""
    model = fit(documents, fold(F.col("doc_id"), 5) != 0)
    return identify(documents, model).filter("not rejected").select(*documents.columns)


def op5_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; learns from the documents of four folds of five."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(documents, fold(F.col("doc_id"), 5) != 0)
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
