"""Ranked lexical search: the best documents of each query item, by TPUT over term-partitioned postings.

One pass over the documents writes the postings of the terms that items have, with counts of their texts; what a posting
adds to a score (its impact) is the same for every item, so lists by term, highest impact first, serve all of them.  Then
three phases for all items at once:

1. The heads of the lists, as many postings as documents are wanted, are summed by item and document.  The documents with
   the highest sums, ``TRIED`` times as many as are wanted, are looked up in all lists.  The last wanted score of these is a
   lower bound: so much is reached by as many documents as are wanted.  (Sums of heads alone are a lower bound too, but
   so low that far more postings are fetched.)
2. That bound over the item's number of lists, or a whole fraction of it (``SHARE``), is one threshold for each of them: a
   document without a posting at the threshold in any list cannot reach the bound.  All postings from it on are fetched
   and summed, which gives a better lower bound, and an upper one for each document: its sum, and for each list that it
   was not met in the threshold, or the list's highest impact if that is less.  A lower threshold fetches a little more
   and leaves far fewer documents to look up.
3. Documents whose upper bound reaches the lower one are looked up in all lists of their item, for exact scores.

Nothing is approximate: impacts are whole numbers and every document that might be among the best is looked up.

Scale: only postings of the items' terms are written and shuffled; lists are dealt by term and, where long, by parts of
``LIST_ROWS``; heads are cut in each task before they meet.  The terms that a pass over the documents looks for are
broadcast, at most about ``MOST_TERMS`` of them; more terms take more passes.  Tables by item or term are broadcast only
if they have at most so many rows, else joined.  Looked-up postings are first picked by a bitmap of fixed size.

Defined results: null and empty texts and texts without terms are no documents (they count nowhere and rank nowhere);
items with such texts get no rows; a repeated row is a document (or an item) of its own; documents of equal score are
ranked by id, null ids last, and repeated ids in a fixed order of rows; terms may be of any length; texts are read whole,
long ones in windows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, drop, id_filter, lean, passes, written

#: Documents of an item that are returned.
BEST = 50
#: Documents that are looked up for the first bound, times those that are wanted.
TRIED = 4
#: The threshold is the bound over the number of lists and over this.
SHARE = 4
#: About so many terms are looked for in one pass over the documents, and are the rows of a table that is broadcast.
MOST_TERMS = 1 << 18
#: Bytes of the terms of one pass.
MOST_TERM_BYTES = 1 << 25
#: Postings of one list that are dealt together.
LIST_ROWS = 1 << 16
#: Bytes of a text that are split at once.
WINDOW = 1 << 22

#: Separators become spaces, capitals small letters; bytes of other characters than ASCII belong to terms.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def windows(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in runs of bounded size (a term is never cut)."""
    data, at = (text or b"").translate(_FOLD), 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut if cut > at else data.find(b" ", end) % (len(data) + 1)
        yield data[at:end].split()
        at = end


def _binary(column: str) -> Column:
    return F.col(column).cast("string").cast("binary")


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id and term (binary), once each."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        seen = TaskContext.get().partitionId() << 36
        for batch in batches:
            at, terms = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = set().union(*windows(text))
                at += [i] * len(own)
                terms += own
            place = pa.array(at, pa.int64())
            numbers = pa.array([seen + i for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, batch.column(0).take(place), pa.array(terms, pa.binary())], ["item", "item_id", "bytes"])
            seen += batch.num_rows

    return items.select("item_id", _binary("text").alias("text")).mapInArrow(lean(run), f"item long, item_id {kind}, bytes binary")


def _found(documents: DataFrame, wanted, own_rows: bool) -> DataFrame:
    """term, row, tf, n, doc_id: a posting of each document for each wanted term that it has; own_rows: also a row with a
    null term for each document.  n: the number of a document's terms with repeats."""
    names = ["term", "row", "tf", "n", "doc_id"]

    def run(batches):
        seen, terms = TaskContext.get().partitionId() << 36, wanted.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), seen):
                n, held = 0, Counter()
                for window in windows(text):
                    n += len(window)
                    met = Counter(window)
                    for t in met.keys() & terms.keys():
                        held[t] += met[t]
                if n:
                    found = list(held.items())
                    rows = [terms[t] for t, _ in found], [i] * len(found), [k for _, k in found], [n] * len(found), [None] * len(found)
                    if own_rows:
                        rows = [[None], [i], [None], [n], [doc_id]] if not found else [[*x, y] for x, y in zip(rows, (None, i, None, n, doc_id), strict=True)]
                    for column, x in zip(out, rows, strict=True):
                        column += x
                if len(out[0]) > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                    out = [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
            seen += batch.num_rows

    texts = documents.select(F.col("doc_id").cast("long"), _binary("text").alias("text"))
    return texts.mapInArrow(lean(run), "term long, row long, tf long, n long, doc_id long")


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table as the small side of a join, if its number of rows allows that."""
    return F.broadcast(table) if rows <= MOST_TERMS else table


def _nth(sums: DataFrame, value: str, nth: int, name: str) -> DataFrame:
    """item and the nth largest value; items with fewer stay out."""
    order = Window.partitionBy("item").orderBy(F.desc(value), "row")
    ranked = sums.select("item", "row", value, F.row_number().over(order).alias("_n")).filter(F.col("_n") <= nth)
    return ranked.filter(F.col("_n") == nth).select("item", F.col(value).alias(name))


def _scores(lists: DataFrame, wanted: DataFrame, lined: DataFrame, n_asked: int, hit: bytes) -> DataFrame:
    """item, row and score of the wanted ones, looked up in all lists of their item."""
    looked_up = wanted.join(_small(lined.select("item", "term"), n_asked), "item")
    found = lists.filter(passes(lists.sparkSession, hit, "row")).join(looked_up, ["term", "row"])
    return found.groupBy("item", "row").agg(F.sum("impact").alias("score"))


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the best documents of each item, scores above 0."""
    spark = documents.sparkSession
    bounded_batches(spark)
    asked = written(item_terms(items), "search-items")
    named = asked.select("bytes").distinct().select("bytes", F.monotonically_increasing_id().alias("term"))
    terms = written(named, "search-terms")
    n_terms, n_bytes = terms.agg(F.count("term"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()
    n_asked = asked.count()
    passes_needed = max(1, -(-n_terms // MOST_TERMS), -(-n_bytes // MOST_TERM_BYTES))
    found = []
    for k in range(passes_needed):
        held = terms.filter(F.pmod(F.xxhash64("bytes"), F.lit(passes_needed)) == k).toArrow().to_pydict()
        wanted = spark.sparkContext.broadcast(dict(zip(held["bytes"], held["term"], strict=True)))
        # A table for each pass: a row's number is its task's and its place there, and tasks of a union are numbered on.
        found.append(written(_found(documents, wanted, k == 0), "search-postings"))
    postings = reduce(DataFrame.union, found)
    whole = postings.filter("term is null")
    count, words = whole.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Lists by term with the impact of each posting.
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * count + 2) / (2 * F.col("df") + 1)))
    weights = postings.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", weight.alias("w"))
    m = f"(50 + (50 * n * {count}L) div {max(words, 1)}L)"
    weighed = postings.filter("term is not null").join(_small(weights, n_terms), "term")
    impact = F.expr(f"w * ((1000000000L * tf) div (1000 * tf + 20 * {m}))")
    part = F.pmod(F.xxhash64("row"), F.col("df") / F.lit(LIST_ROWS) + 1).cast("int")
    lists = weighed.select("term", "row", impact.alias("impact"), part.alias("part")).filter("impact > 0")
    lists = written(lists.repartition("term", "part").sortWithinPartitions("term", F.desc("impact"), "row").drop("part"), "search-lists")

    # Phase 1: heads of lists give a lower bound of each item's last wanted score.
    heads = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    heads = written(lists.withColumn("_n", F.row_number().over(heads)).filter(F.col("_n") <= best), "search-heads")
    tops = heads.filter("_n = 1").select("term", F.col("impact").alias("top"))
    lined = written(asked.join(terms, "bytes").join(tops, "term").select("item", "term", "top"), "search-lines")
    sums = heads.join(_small(lined, n_asked), "term").groupBy("item", "row").agg(F.sum("impact").alias("seen"))
    first = Window.partitionBy("item").orderBy(F.desc("seen"), "row")
    tried = sums.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= TRIED * best).select("item", "row")
    tried = written(tried, "search-tried")
    bound = _nth(_scores(lists, tried, lined, n_asked, id_filter(tried, "row")), "score", best, "bound")

    # Phase 2: one threshold for all lists of an item.  unseen: the most that a posting below it can have.
    per_item = lined.groupBy("item").agg(F.count(F.lit(1)).alias("lists")).join(bound, "item", "left")
    per_item = per_item.select("item", "lists", F.coalesce("bound", F.lit(0)).alias("bound"))
    below = F.greatest(F.lit(0), F.expr(f"(bound - 1) div (lists * {SHARE})"))
    lines = lined.join(per_item, "item").select("item", "term", "lists", "bound", below.alias("below"), F.least("top", below).alias("unseen"))
    lines = written(lines, "search-thresholds")
    missed = lines.groupBy("item").agg(F.sum("unseen").alias("all_unseen"), F.max("bound").alias("bound"))
    # A posting is fetched once for all items and dealt by document; its items are found there, so sums need no other deal.
    lowest = lines.groupBy("term").agg(F.min("below").alias("lowest"))
    fetched = lists.join(_small(lowest, n_terms), "term").filter("impact > lowest").select("term", "row", "impact").repartition("row")
    fetched = fetched.join(_small(lines, n_asked), "term").filter("impact > below")
    met = fetched.groupBy("item", "row").agg(F.sum("impact").alias("seen"), F.sum("unseen").alias("not_missed"))
    met = met.join(_small(missed, n_asked), "item").withColumn("most", F.expr("seen + all_unseen - not_missed")).filter("most >= bound")
    met = written(met.select("item", "row", "seen", "most"), "search-met")
    better = _nth(met, "seen", best, "bound")
    candidates = met.join(_small(better, n_asked), "item", "left").filter("most >= coalesce(bound, 0)").select("item", "row")
    candidates = written(candidates, "search-candidates")

    # Phase 3: exact scores of what is left.
    hit = id_filter(candidates, "row")
    exact = _scores(lists, candidates, lined, n_asked, hit)
    own = whole.filter(passes(spark, hit, "row")).select("row", "doc_id")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = exact.join(own, "row").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    ranked = written(ranked.select("item", "rank", "doc_id", "score"), "search-ranked")
    ids = asked.select("item", "item_id").distinct()
    drop(terms, *found, lists, heads, tried, lined, lines, met, candidates)
    return ranked.join(_small(ids, n_asked), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
i AS (
  SELECT row_number() OVER () AS k, item_id,
         list_distinct(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS ws
  FROM benchmark),
s AS (SELECT count(*) AS c, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT unnest(ws) AS t FROM i),
o AS (SELECT r, unnest(ws) AS t FROM d),
p AS (SELECT r, t, count(*) AS tf FROM o WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * (SELECT c FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY t),
m AS (SELECT r, doc_id, 50 + ((50 * len(ws) * (SELECT c FROM s)) // (SELECT l FROM s)) AS m FROM d WHERE len(ws) > 0),
x AS (SELECT p.r, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m)) AS impact FROM p JOIN w USING (t) JOIN m USING (r)),
n AS (SELECT k, item_id, unnest(ws) AS t FROM i),
y AS (SELECT n.k, n.item_id, x.r, sum(x.impact)::BIGINT AS score FROM n JOIN x USING (t) GROUP BY n.k, n.item_id, x.r),
z AS (SELECT y.k, y.item_id, m.doc_id, y.score,
             row_number() OVER (PARTITION BY y.k ORDER BY y.score DESC, m.doc_id NULLS LAST, y.r) AS rank
      FROM y JOIN m USING (r) WHERE y.score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM z WHERE rank <= 50
"""
