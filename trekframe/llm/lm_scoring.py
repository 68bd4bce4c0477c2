"""Language-model scoring: stupid backoff as joins of n-gram count tables with exploded n-grams.

A word after ``order - 1`` others (or as many as its text has before it) scores ``count(gram) / count(context)`` where the
gram is known, else ``0.4`` times the score with the first word of the context left out; without a context it scores
``count(word) / words``.  A document's score is the sum of logarithms over its whole text.  Words are lower-cased (A-Z) and
separated by white space; words and grams are 64-bit hashes.

``scores`` takes the corpus itself as the model and drops no count, so every gram of a scored text is known and no word is
backed off: a text's sum is that of ``log count`` over its grams, less that over its contexts but the first and the last,
less ``log words``.  Grams and contexts are exploded into rows of a document, pre-aggregated by task, and dealt by hash
once.  The count table is an aggregate of these rows where they lie, the join with it needs no other shuffle, and values are
summed by document.  Counts of one are left out of the join, as their logarithm is 0.

The ``HOT`` commonest grams and contexts do not go that way: their exact counts are broadcast, tables of at most ``HOT``
rows each however large the corpus is.  What is dealt by hash is then free of hot keys: no key has more than a
``HOT``-th of all occurrences (or a few in every task), so no task gets a large group.

``scores_under`` takes the counts of another corpus and does back off: every gram of every length is joined with its count
and its context's, and the longest known one scores.  A word the corpus lacks counts as met once.

Defined results: null and empty texts and texts without words have 0 words, score 0 and a null mean; repeated rows are
counted and scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, lean, slices, word_hashes, written
from .ngram_counts import commonest, gram_counts, gram_hashes, lookup

BACKOFF = 0.4
#: Most grams, and most contexts, whose counts are broadcast.
HOT = 1 << 20
#: A run of words is a candidate for that if one task meets it so often.
CANDIDATE = 4
#: Kinds of exploded rows besides the sizes of grams: a document's known part, its id, a text shorter than a context.
_KNOWN, _ID, _SHORT = 0, -1, -2


def _once(keys: np.ndarray, of: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, of, times, weights) with a row for each key of each document."""
    order = np.lexsort((of, keys))
    keys, of, weights = keys[order], of[order], weights[order]
    new = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(of, prepend=-1) != 0))
    if not len(new):
        return keys, of, of, weights
    return keys[new], of[new], np.diff(np.append(new, len(keys))), np.add.reduceat(weights, new)


def exploded(documents: DataFrame, order: int, hot) -> DataFrame:
    """kind, key, row, times, weight: what documents' scores are summed from.

    Of kind ``order`` or ``order - 1``: a gram or context that is not hot, how often the row has it and how often its
    ``log count`` is taken.  Of other kinds, with the row as key: the known part (weight) and the number of words (times);
    the doc_id (times); the length (weight) and hash (times) of a text shorter than a context.  A row's number is its
    task's and its place there, so it is the same if the task runs again.
    """
    width = order - 1

    def batch_of(kind: int, key, row, times, weight):
        columns = [np.full(len(key), kind, dtype=np.int32), key.view(np.int64), row, times, weight]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "key", "row", "times", "weight"])

    def run(batches):
        (hot_contexts, context_logs), (hot_grams, gram_logs), total = hot.value
        seen = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in slices(texts, 2 << 20):
                rows = np.arange(seen + begin, seen + end)
                words, starts = word_hashes(texts[begin:end].to_pylist())
                lengths = np.diff(starts)
                text = np.repeat(np.arange(end - begin), lengths)
                known = np.where(lengths > 0, -np.log(total), 0.0)
                at, contexts = gram_hashes(words, starts, width)
                of = text[at]
                # 1 for the first context, -1 for each that a word follows
                weights = (at == starts[of]).astype(np.float64) - (at + width < starts[of + 1])
                gram_at, grams = gram_hashes(words, starts, order)
                for kind, keys, doc, weight, table, logs in (
                    (width, contexts, of, weights, hot_contexts, context_logs),
                    (order, grams, text[gram_at], np.ones(len(grams)), hot_grams, gram_logs),
                ):
                    values = lookup(table, logs, keys)
                    cold = np.isnan(values)
                    known += np.bincount(doc[~cold], weights=weight[~cold] * values[~cold], minlength=len(rows))
                    key, doc, times, weight = _once(keys[cold], doc[cold], weight[cold])
                    yield batch_of(kind, key, rows[doc], times, weight)
                yield batch_of(_KNOWN, rows, rows, lengths, known)
                has_id = ids[begin:end].is_valid().to_numpy(zero_copy_only=False)
                named = ids[begin:end].fill_null(0).to_numpy(zero_copy_only=False)[has_id]
                yield batch_of(_ID, rows[has_id], rows[has_id], named, np.zeros(len(named)))
                for size in range(1, width):
                    first, hashes = gram_hashes(words, starts, size)
                    short = lengths[text[first]] == size
                    mine = rows[text[first[short]]]
                    yield batch_of(_SHORT, mine, mine, hashes[short].view(np.int64), np.full(len(mine), float(size)))
            seen += batch.num_rows

    return documents.mapInArrow(lean(run), "kind int, key long, row long, times long, weight double")


def _with_mean(summed: DataFrame) -> DataFrame:
    score = F.when(F.col("n_words") > 0, F.col("score"))
    return summed.select("doc_id", "n_words", F.coalesce(score, F.lit(0.0)).alias("score"), (score / F.col("n_words")).alias("mean"))


def scores(documents: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, n_words, score (sum of natural logarithms) and mean (by word) for every row of documents, by the counts of
    documents itself."""
    if order < 2:
        raise ValueError("order must be at least 2")
    width, broadcast = order - 1, documents.sparkSession.sparkContext.broadcast
    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    shorter = dict.fromkeys(range(1, width), 1)
    met = written(gram_counts(named, shorter | {width: CANDIDATE, order: CANDIDATE}), "lm-met")
    wanted = broadcast({size: commonest(met, size, HOT)[0] for size in (width, order)})
    exact = written(gram_counts(named, {0: 1, width: 1, order: 1}, wanted), "lm-hot")
    tables = [commonest(exact, size, HOT) for size in (width, order)]
    total = float(exact.filter("size = 0").agg(F.sum("n")).first()[0] or 1)
    drop(exact)
    hot = broadcast((*((keys, np.log(n)) for keys, n in tables), total))
    rows = exploded(named, order, hot).repartition("kind", "key")
    counts = rows.groupBy("kind", "key").agg(F.sum("times").alias("n"), F.count("row").alias("docs"), F.max(F.abs("weight")).alias("most"))
    # The logarithm of 1 is 0.  As all columns are asked for here too, both sides of the join read one exchange.
    counts = counts.filter(f"kind < {width} or n > 1 and docs > 0 and most > 0").select("kind", "key", "n")
    value = F.when(F.col("kind") >= width, F.col("weight") * F.log("n")).when(F.col("kind") == _KNOWN, F.col("weight"))
    is_kind = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    summed = (
        rows.join(counts, ["kind", "key"])
        .groupBy("row")
        .agg(
            F.max(is_kind(_ID, "times")).alias("doc_id"),
            F.max(is_kind(_KNOWN, "times")).alias("n_words"),
            F.sum(value).alias("score"),
            F.max(is_kind(_SHORT, "times")).alias("short"),
            F.max(is_kind(_SHORT, "weight")).cast("int").alias("short_size"),
        )
    )
    if shorter:
        known = met.filter(F.col("size") < width).select(F.col("size").alias("short_size"), F.col("key").alias("short"), "n")
        summed = summed.join(known, ["short_size", "short"], "left").withColumn("score", F.col("score") + F.coalesce(F.log("n"), F.lit(0.0)))
    return _with_mean(summed)


def positions(documents: DataFrame, order: int) -> DataFrame:
    """row, doc_id, place, size, gram, context: every gram of up to ``order`` words that ends at a place, with the hash of
    its words but the last; one row with a null place for each row of documents."""
    schema = "row long, doc_id long, place long, size int, gram long, context long"

    def run(batches):
        seen = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in slices(texts):
                rows = pa.array(np.arange(seen + begin, seen + end))
                nothing = pa.nulls(end - begin, pa.int64())
                yield pa.RecordBatch.from_arrays([rows, ids[begin:end], nothing, nothing.cast(pa.int32()), nothing, nothing], schema_names)
                words, starts = word_hashes(texts[begin:end].to_pylist())
                text = np.repeat(np.arange(end - begin), np.diff(starts))
                before = None
                for size in range(1, order + 1):
                    at, grams = gram_hashes(words, starts, size)
                    own = pa.array(text[at])
                    context = pa.nulls(len(at), pa.int64()) if before is None else pa.array(before[at])
                    columns = [rows.take(own), ids[begin:end].take(own), at + size - 1, np.full(len(at), size, dtype=np.int32), grams.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns] + [context], schema_names)
                    before = np.zeros(len(words), dtype=np.int64)
                    before[at] = grams.view(np.int64)
            seen += batch.num_rows

    schema_names = [x.split()[0] for x in schema.split(", ")]
    return documents.mapInArrow(lean(run), schema)


def scores_under(documents: DataFrame, corpus: DataFrame, order: int = 2, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, score and mean for every row of documents, by the counts of another corpus."""
    if order < 1:
        raise ValueError("order must be at least 1")
    counts = written(gram_counts(corpus, dict.fromkeys(range(1, order + 1), 1)), "lm-counts")
    total = F.lit(float(counts.filter("size = 1").agg(F.sum("n")).first()[0] or 1))
    named = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    rows = written(positions(named, order), "lm-positions")
    grams = counts.select("size", F.col("key").alias("gram"), F.col("n").alias("of_gram"))
    contexts = counts.select((F.col("size") + 1).alias("size"), F.col("key").alias("context"), F.col("n").alias("of_context"))
    found = rows.filter("place is not null").join(grams, ["size", "gram"], "left").join(contexts, ["size", "context"], "left")
    ratio = F.when(F.col("size") == 1, F.coalesce("of_gram", F.lit(1)) / total).otherwise(F.col("of_gram") / F.col("of_context"))
    known = found.withColumn("ratio", ratio).groupBy("row", "place").agg(
        F.max(F.when(F.col("ratio").isNotNull(), F.col("size"))).alias("used"),
        F.max("size").alias("longest"),
        F.max_by(F.log("ratio"), F.when(F.col("ratio").isNotNull(), F.col("size"))).alias("value"),
    )
    value = F.col("value") + (F.col("longest") - F.col("used")) * F.log(F.lit(backoff))
    sums = known.groupBy("row").agg(F.count(F.lit(1)).alias("n_words"), F.sum(value).alias("score"))
    whole = rows.filter("place is null").select("row", "doc_id").join(sums, "row", "left")
    return _with_mean(whole.withColumn("n_words", F.coalesce("n_words", F.lit(0)).cast("long")))


def _scored(spark: SparkSession, sf_dir: str, order: int, places: int) -> DataFrame:
    found = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), order)
    return found.select("doc_id", "n_words", F.round("mean", places).alias("mean_log"))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log probability of a word in every document, by pairs of words of which none is dropped."""
    return _scored(spark, sf_dir, 2, 6)


def op9_whole_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_stupid_backoff to three places."""
    return _scored(spark, sf_dir, 2, 3)


def op9_whole_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log probability of a word in every document, by the two words before it."""
    return _scored(spark, sf_dir, 3, 3)


def op9_under_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log probability of a word in every document, by the pairs of words of all conversations: most pairs are
    unknown to those, and their words are backed off."""
    documents, turns = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "conversations"))
    found = scores_under(documents, turns.select("text"))
    return found.select("doc_id", "n_words", F.round("mean", 6).alias("mean_log"))


_WORDS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
"""

WHOLE_SQL = _WORDS + r"""
t AS (SELECT r, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS p FROM d),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w),
s AS (
  SELECT t.r, count(*) AS n,
         sum(CASE WHEN t.p IS NULL THEN ln(u.c / (SELECT count(*) FROM t))
                  WHEN b.c IS NOT NULL THEN ln(b.c / f.c)
                  ELSE ln(0.4 * u.c / (SELECT count(*) FROM t)) END) AS score
  FROM t JOIN u ON t.w = u.w LEFT JOIN u AS f ON t.p = f.w LEFT JOIN b ON t.p = b.p AND t.w = b.w
  GROUP BY t.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(s.score / s.n, 3) AS mean_log
FROM d LEFT JOIN s ON d.r = s.r
"""

OP9_SQL = WHOLE_SQL.replace("round(s.score / s.n, 3)", "round(s.score / s.n, 6)")

UNDER_SQL = _WORDS + r"""
t AS (SELECT r, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS p FROM d),
k AS (SELECT row_number() OVER () AS r,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM conversations),
o AS (SELECT r, unnest(ws) AS w, unnest(list_prepend(NULL, ws[:-2])) AS p FROM k),
u AS (SELECT w, count(*) AS c FROM o GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM o WHERE p IS NOT NULL GROUP BY p, w),
n AS (SELECT greatest(1, count(*)) AS c FROM o),
s AS (
  SELECT t.r, count(*) AS n,
         sum(CASE WHEN b.c IS NOT NULL THEN ln(b.c / f.c)
                  ELSE ln(CASE WHEN t.p IS NULL THEN 1 ELSE 0.4 END * coalesce(u.c, 1) / (SELECT c FROM n)) END) AS score
  FROM t LEFT JOIN u ON t.w = u.w LEFT JOIN u AS f ON t.p = f.w LEFT JOIN b ON t.p = b.p AND t.w = b.w
  GROUP BY t.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(s.score / s.n, 6) AS mean_log
FROM d LEFT JOIN s ON d.r = s.r
"""

TRIGRAM_SQL = _WORDS + r"""
t AS (SELECT r, unnest(ws) AS w, unnest(list_prepend(NULL, ws)[1:len(ws)]) AS p,
             unnest(list_prepend(NULL, list_prepend(NULL, ws))[1:len(ws)]) AS q FROM d),
u AS (SELECT w, count(*) AS c FROM t GROUP BY w),
b AS (SELECT p, w, count(*) AS c FROM t WHERE p IS NOT NULL GROUP BY p, w),
g AS (SELECT q, p, w, count(*) AS c FROM t WHERE q IS NOT NULL GROUP BY q, p, w),
s AS (
  SELECT t.r, count(*) AS n,
         sum(CASE WHEN t.p IS NULL THEN ln(u.c / (SELECT count(*) FROM t))
                  WHEN g.c IS NOT NULL THEN ln(g.c / h.c)
                  WHEN b.c IS NOT NULL THEN ln(CASE WHEN t.q IS NULL THEN 1 ELSE 0.4 END * b.c / f.c)
                  ELSE ln(CASE WHEN t.q IS NULL THEN 0.4 ELSE 0.4 * 0.4 END * u.c / (SELECT count(*) FROM t)) END) AS score
  FROM t JOIN u ON t.w = u.w LEFT JOIN u AS f ON t.p = f.w LEFT JOIN b ON t.p = b.p AND t.w = b.w
  LEFT JOIN b AS h ON t.q = h.p AND t.p = h.w LEFT JOIN g ON t.q = g.q AND t.p = g.p AND t.w = g.w
  GROUP BY t.r)
SELECT d.doc_id, coalesce(s.n, 0) AS n_words, round(s.score / s.n, 3) AS mean_log
FROM d LEFT JOIN s ON d.r = s.r
"""
