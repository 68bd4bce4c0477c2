"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are densities of a learned lexicon (plain and after undoing obfuscation), its nearness to
second-person words, capitals, punctuation, and rates of obfuscated spellings.  The lexicon holds the words and
word stems that mark labelled toxic texts; its features are crossed in training (a text's come from the lexicon of the
folds it is not in), so trees do not trust words that mark single texts.  Trees learn from two thirds of the training
texts and the calibration from the others.

Lexicon, trees and calibration are fitted on a hashed sample of at most about ``SAMPLE`` training texts of each label
(whole texts); every text is then scored where it is read, without a shuffle.

Defined results: null texts count as empty and are scored like any; rows with a null id are scored but not learned
from; of several labels of an id the largest counts, null labels do not; without training texts of both labels all
scores are the training share of label 1 (0 without any); an empty table gives an empty result; other columns are
ignored or carried along.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, lean, written

#: Most training texts of a label, about.
SAMPLE = 3000
LEXICON_WORDS = 300
FOLDS, STEMS = 4, (4, 5, 6, 7)
LEAST_TEXTS, LEAST_ODDS = 3, 2.0
TREES, DEPTH = 16, 3
NEAR = 6
#: Fixed value: second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
#: Fixed value: characters that stand for letters.
_STAND_INS = str.maketrans("013457@$!€", "oieastasie")
_EDGES = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")
_MIXED = re.compile(r"[^\W\d_][0-9@$*#!€.\-_]+[^\W\d_]|(.)\1{3}")
_HIT, _HIDDEN, _SECOND, _MASKED, _SHOUT = 1, 2, 4, 8, 16
FEATURES = (
    "lexicon", "lexicon_hits", "hidden", "second_person", "near_second_person", "capitals", "shouted_words", "exclamations", "marks", "masked", "words",
)
_MOST_KEPT = 300_000


class WordKinds(dict):
    """Flags of a word as it stands in a text, worked out when first met."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > _MOST_KEPT:
            self.clear()
        bare = _EDGES.sub("", word)
        low, out = bare.lower(), 0
        if low in self.lexicon or any(low[:k] + "~" in self.lexicon for k in STEMS if len(low) > k):
            out |= _HIT
        elif not low.isalpha():
            plain = low.translate(_STAND_INS)
            if re.sub(r"[\W_]", "", plain) in self.lexicon or re.sub(r"[\W\d_]", "", low) in self.lexicon:
                out |= _HIT | _HIDDEN
            if _MIXED.search(low):
                out |= _MASKED
        if low in SECOND_PERSON:
            out |= _SECOND
        if len(bare) > 1 and bare.isupper():
            out |= _SHOUT
        self[word] = out
        return out


def features(text: str, kinds: WordKinds) -> list[float]:
    """The dense features of a text, in the order of FEATURES."""
    words = text.split()
    flags = np.fromiter(map(kinds.__getitem__, words), dtype=np.uint8, count=len(words))
    n = max(1, len(words))
    hits = np.flatnonzero(flags & _HIT)
    second = np.flatnonzero(flags & _SECOND)
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        before = hits - second[np.maximum(at - 1, 0)]
        after = second[np.minimum(at, len(second) - 1)] - hits
        near = int((((before >= 0) & (before <= NEAR)) | ((after >= 0) & (after <= NEAR))).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    upper, lower, other = int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[192:].sum())
    letters = max(1, upper + lower + other)
    marks = int(by_byte[[33, 44, 46, 58, 59, 63]].sum())
    return [
        len(hits) / n,
        math.log1p(len(hits)),
        int((flags & _HIDDEN).astype(bool).sum()) / n,
        len(second) / n,
        near / n,
        upper / letters,
        int((flags & _SHOUT).astype(bool).sum()) / n,
        int(by_byte[33]) / n,
        marks / n,
        int((flags & _MASKED).astype(bool).sum()) / n,
        math.log1p(len(words)),
    ]


def with_features(rows: DataFrame, lexicons: list[list[str]]) -> DataFrame:
    """rows with column features (array of doubles) in the place of text; column lexicon chooses among lexicons."""
    kept = [c for c in rows.columns if c not in ("text", "lexicon")]
    named = rows.select(*kept, F.col("lexicon").cast("int"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        kinds = [WordKinds(frozenset(x)) for x in lexicons]
        for batch in batches:
            which, texts = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()
            found = [features(t, kinds[k]) for k, t in zip(which, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(found, pa.list_(pa.float64()))], [*kept, "features"]
            )

    return named.mapInArrow(lean(run), named.drop("lexicon", "text").schema.add("features", T.ArrayType(T.DoubleType())))


def lexicons(rows: DataFrame, folds: int = FOLDS, most: int = LEXICON_WORDS) -> list[list[str]]:
    """Lexicons of rows (label, fold, text): one without each fold, then one of all rows.

    A term is a word or a stem, its first 4 to 7 letters and a tilde.  A lexicon holds those that mark label 1: in
    three of its texts at least and far more often there.
    """
    bare = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), 0)
    stem = lambda w, k: F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("~")))
    terms = F.flatten(F.transform(F.array_distinct(bare), lambda w: F.array(w, *(stem(w, k) for k in STEMS))))
    met = rows.select("label", "fold", F.explode(F.array_distinct(F.array_compact(terms))).alias("term"))
    keys = [(label, fold) for label in (1, 0) for fold in range(folds)]
    is_key = lambda label, fold: (F.col("label") == label) & (F.col("fold") == fold)
    all_sums = rows.agg(*(F.count(F.when(is_key(*k), 1)).alias(f"x{k[0]}{k[1]}") for k in keys)).first()
    sums = met.groupBy("term").agg(*(F.count(F.when(is_key(*k), 1)).alias(f"x{k[0]}{k[1]}") for k in keys))
    p, n = (sum((F.col(f"x{label}{f}") for f in range(folds)), F.lit(0)) for label in (1, 0))
    # Terms that can mark label 1 without some fold do so nearly as well with all; the others need not be fetched.
    likely = sums.filter((p >= LEAST_TEXTS) & (p > n)).orderBy((p - n).desc(), "term").limit(50 * most).collect()

    def chosen(without: int) -> list[str]:
        count = lambda row, label: sum(row[f"x{label}{f}"] for f in range(folds) if f != without)
        all_p, all_n = count(all_sums, 1), count(all_sums, 0)
        found = []
        for row in likely:
            p, n = count(row, 1), count(row, 0)
            odds = math.log((p + 0.5) / (all_p + 1)) - math.log((n + 0.5) / (all_n + 1))
            if p >= LEAST_TEXTS and odds > LEAST_ODDS:
                found.append((-odds * math.sqrt(p), row["term"]))
        return [term for _, term in sorted(found)[:most]]

    return [chosen(f) for f in range(folds + 1)]


class Toxicity:
    """A fitted lexicon with its trees and calibration; rate alone where labels do not allow more."""

    def __init__(self, rate: float, words: list[str], trees=None, curve=None):
        self.rate, self.words, self.trees, self.curve = rate, words, trees, curve

    def score(self, documents: DataFrame) -> DataFrame:
        """documents with column score in the place of text."""
        if self.trees is None:
            return documents.drop("text").withColumn("score", F.lit(self.rate))
        kept = [c for c in documents.columns if c.lower() not in ("text", "score")]
        row = F.struct(*kept).alias("_row")  # out of the way of the columns that the models add
        rows = with_features(documents.select(row, "text", F.lit(0).alias("lexicon")), [self.words])
        return _calibrated(rows, self.trees, self.curve).select("_row.*", "score")


def _raw(rows: DataFrame, trees) -> DataFrame:
    found = trees.transform(rows.withColumn("_vector", array_to_vector("features")))
    return found.withColumn("_raw", vector_to_array("probability")[1])


def _calibrated(rows: DataFrame, trees, curve) -> DataFrame:
    """The calibrated score, with a trace of the trees' own so that equal steps keep their order."""
    fitted = curve.transform(_raw(rows, trees))
    return fitted.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("_fitted") + 0.02 * F.col("_raw"))))


def fit(documents: DataFrame, labels: DataFrame, learns: Column, sample: int = SAMPLE) -> Toxicity:
    """Learns from documents (doc_id, text) with labels (doc_id, toxic) for which ``learns``, a test of doc_id, holds."""
    named = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learns)
    named = named.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    # Rows that repeat id and text count once, so that a sample is bounded however often an id is met.
    keyed = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    keys = keyed.select("doc_id", "_key").filter(learns).distinct().join(named, "doc_id")
    sizes = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    rate = positive / (positive + negative) if positive + negative else 0.0
    if not positive or not negative:
        return Toxicity(rate, [])
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id", "_key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = keys.filter(draw < F.when(F.col("label") == 1, sample / positive).otherwise(sample / negative))
    cross = F.pmod(F.xxhash64(F.lit("cross"), "doc_id", "_key"), F.lit(FOLDS)).cast("int")
    texts = keyed.join(F.broadcast(drawn), ["doc_id", "_key"])  # about 2 * sample keys
    texts = texts.groupBy("doc_id", "_key", "label").agg(F.first("text").alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "_key"), F.lit(3))
    rows = written(texts.select("doc_id", "label", cross.alias("fold"), part.alias("part"), "text"), "toxicity-texts")
    *crossing, whole = lexicons(rows)
    crossed = with_features(rows.select("label", "part", "text", F.col("fold").alias("lexicon")), crossing)
    weight = F.when(F.col("label") == 1, max(1.0, positive / sample)).otherwise(max(1.0, negative / sample))
    ready = written(
        crossed.select(F.col("label").cast("double"), array_to_vector("features").alias("_vector"), weight.alias("weight"), "part").coalesce(4),
        "toxicity-features",
    )
    booster = GBTClassifier(
        featuresCol="_vector", labelCol="label", weightCol="weight", predictionCol="_class", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1,
    )
    trees = booster.fit(ready.filter("part < 2"))
    scored = trees.transform(ready.filter("part = 2")).withColumn("_raw", vector_to_array("probability")[1])
    if scored.isEmpty():
        scored = trees.transform(ready).withColumn("_raw", vector_to_array("probability")[1])
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label", weightCol="weight", predictionCol="_fitted").fit(scored)
    return Toxicity(rate, whole, trees, curve)


def op10_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; learns from the labelled documents of three folds of four."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return model.score(documents).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
