"""Spelling variants: words at edit distance one, by a trie joined with itself, and the form that each word varies.

Words are counted over all documents and dealt by the subtrie they lie in; a subtrie is joined with itself in one descent.
At each node the descent knows its active nodes, those whose strings are exactly one edit from its own:

* its parent (a code point too many), its children (one too few), its siblings (another one), and
* for each active node of its parent the child by the same code point.

A word ends in a mark, so words are leaves, and two words are near when one's leaf is active at the other's.

Subtries by prefix alone would miss edits inside the prefix.  Two near words of at least ``least`` code points share their
first or their last ``least // 2``, so there are two tries, of words and of reversed words, dealt by so long a prefix;
pairs that share the first code points count in the former.  A subtrie of more than ``cell_words`` words is cut further
down, at the first node below which words differ.  Its parts need words of other parts then: the top of the trie is
descended with each of its words by the same rule, and the word visits each part that an active node enters.  So any two
near words meet in the part of either, where they are counted for the word at home.

Scale: counts are summed by task before they meet; a word is dealt twice, and more often only in subtries that were cut.
The cuts are on the driver: of more than ``cell_words`` words each, at least a 65,536th of all words, so there are few.
Roots are found by doubling steps along the forms; frequencies grow fivefold by step, so a few rounds are enough.

Defined results: null and empty texts have no words; a null doc_id deletes by the text ``:<run>``; repeated rows count each;
texts are read whole, long ones as a stream; words of equal frequency are told apart in code-point order; words of any
length are words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, lean, written

#: Runs, shortest word, fewest occurrences, how much more frequent a form is, and of how many runs one loses a code point.
RUNS, LEAST, OCCURRENCES, FORM_TIMES, TYPO = "[A-Za-zÀ-ÿ]", 6, 5, 5, 199
#: Distinct words that a task gathers before it hands their counts on, and characters from which a text is long.
HELD, LONG = 1 << 18, 1 << 22
#: Most words of a subtrie that is joined in one piece.
CELL_WORDS = 1 << 14
#: Ends a word in a trie; no run has it.
END = "\0"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _runs(pattern: re.Pattern, text: str) -> Iterable[str]:
    return pattern.findall(text) if len(text) < LONG else (m[0] for m in pattern.finditer(text))


def words(documents: DataFrame, least: int = LEAST, typo: int = TYPO) -> DataFrame:
    """word and n: the runs of all texts, lower-cased, with one code point deleted from one run in ``typo``."""
    pattern = re.compile(f"{RUNS}{{{least},}}")  # shorter runs cannot become words

    def batch_of(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(_runs(pattern, (data or b"").translate(_LOWER).decode("utf-8", "replace")))
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % typo == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield batch_of(total)
                    total = Counter()
        if total:
            yield batch_of(total)

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Top:
    """The top of a trie that was cut: where each part begins.  splits: a prefix of many words and the length of the
    longest prefix that they share; the next code point parts them."""

    def __init__(self, depth: int, splits: dict[str, int], parts: Iterable[str] = ()):
        self.depth, self.splits, self.parts = depth, splits, set(parts)
        self.below: dict[str, str] = {}
        for part in self.parts:
            for k in range(depth, len(part)):
                node = part[:k]
                if part[k] not in (known := self.below.get(node, "")):
                    self.below[node] = known + part[k]

    def home(self, key: str) -> str:
        """The part that a word lies in."""
        part = key[: self.depth]
        while part in self.splits:
            part = key[: self.splits[part] + 1]
        return part

    def visited(self, key: str) -> list[str]:
        """The other parts that may hold a near word: those that an active node enters on the word's way down."""
        node = key[: self.depth]
        if node not in self.below:
            return []
        home, met, below = self.home(key), set(), self.below
        near = {node + c for c in below[node]}
        inside = True  # whether the way down is still in the top
        for k in range(self.depth, len(key)):
            met |= near & self.parts
            c = key[k]
            if not (inside or near):
                break
            then = {u + c for u in near if c in below.get(u, "")}
            if inside:
                then |= {node + b for b in below[node]} - {node + c}
                then.add(node)
                node += c
                then |= {node + b for b in below.get(node, "")}
                inside = node in below
            near = then
        return sorted((met | near & self.parts) - {home})


def cut(keys: DataFrame, depth: int, cell_words: int) -> Top:
    """The parts of a trie of keys (a written table with the column key), none of more than cell_words words."""
    splits: dict[str, int] = {}
    while True:
        top = keys.sparkSession.sparkContext.broadcast(Top(depth, splits))

        @F.pandas_udf("string")
        def home(key):
            return key.map(top.value.home)

        parts = keys.groupBy(home("key").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"))
        large = parts.filter(F.col("n") > cell_words).select("part", "first", "last").collect()
        if not large:
            break
        splits |= {r["part"]: len(os.path.commonprefix([r["first"], r["last"]])) for r in large}
    if not splits:
        return Top(depth, {})
    roots = [p for p in splits if len(p) == depth]
    under = parts.filter(F.substring("part", 1, depth).isin(roots)).select("part")
    return Top(depth, splits, [r["part"] for r in under.collect()])


class Trie:
    """The words of a part; below: the children of each node by code point."""

    def __init__(self, keys: list[str], skip: int):
        self.below: list[dict[str, int]] = [{}]
        self.leaf_of: dict[int, int] = {}
        for i, key in enumerate(keys):
            at = 0
            for c in key[skip:]:
                found = self.below[at].get(c)
                if found is None:
                    found = self.below[at][c] = len(self.below)
                    self.below.append({})
                at = found
            self.leaf_of[at] = i

    def near(self, wanted: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """For each wanted word the words one edit from it, as places in the keys."""
        below, leaf_of = self.below, self.leaf_of
        # Only nodes with a wanted word below them are descended to.
        ahead = [False] * len(below)
        for leaf, i in leaf_of.items():
            ahead[leaf] = bool(wanted[i])
        for node in range(len(below) - 1, -1, -1):  # children come after their parents
            ahead[node] = ahead[node] or any([ahead[x] for x in below[node].values()])
        stack = [(0, list(below[0].values()))]
        while stack:
            node, active = stack.pop()
            own = below[node]
            if node in leaf_of:
                yield leaf_of[node], [leaf_of[u] for u in active if u in leaf_of]
            for c, child in own.items():
                if ahead[child]:
                    then = [x for u in active if (x := below[u].get(c)) is not None and x != child]
                    then += [x for x in own.values() if x != child]
                    then.append(node)
                    then += below[child].values()
                    stack.append((child, list(set(then))))


def _joined(keys: list[str], counts: list[int], at_home: list[bool], words_of: list[str], reverse: bool, depth: int, skip: int):
    """word, n, n_near, form and form_n of each word that is at home; form: the most frequent near word."""
    for i, found in Trie(keys, skip).near(np.array(at_home)):
        word = words_of[i]
        if reverse:  # those that share the beginning are met in the other trie
            found = [j for j in found if words_of[j][:depth] != word[:depth]]
        best = min(found, key=lambda j: (-counts[j], words_of[j]), default=None)
        yield word, counts[i], len(found), None if best is None else words_of[best], None if best is None else counts[best]


_NEAR = "word string, n long, n_near long, form string, form_n long"


def near_words(counted: DataFrame, least: int = LEAST, cell_words: int = CELL_WORDS) -> DataFrame:
    """word, n, n_near, form and form_n (null if there is none) of counted (word, n; a written table, distinct words of at
    least so many code points): the number of near words, and the most frequent of them."""
    depth, spark = least // 2, counted.sparkSession
    cell_words = max(cell_words, counted.count() >> 16)
    found = None
    for reverse in (False, True):
        text = F.reverse("word") if reverse else F.col("word")
        keys = counted.select("word", "n", F.concat(text, F.lit(END)).alias("key"))
        top = spark.sparkContext.broadcast(cut(keys, depth, cell_words))

        @F.pandas_udf("array<string>")
        def places(key):
            return key.map(lambda k: [top.value.home(k), *top.value.visited(k)])

        if top.value.splits:
            dealt = keys.select("word", "n", "key", F.posexplode(places("key")).alias("at", "part"))
        else:
            dealt = keys.select("word", "n", "key", F.lit(0).alias("at"), F.substring("key", 1, depth).alias("part"))

        def run(batches, reverse=reverse):
            held: list[tuple] = []
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
                out: list[tuple] = []
                for row in rows:
                    if held and held[-1][4] != row[4]:
                        out += part_of(held, reverse)
                        held = []
                    held.append(row)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in part_of(held, reverse)], schema)

        def part_of(rows: list[tuple], reverse: bool):
            words_of, counts, keys, at, _ = (list(x) for x in zip(*rows, strict=True))
            return list(_joined(keys, counts, [k == 0 for k in at], words_of, reverse, depth, len(os.path.commonprefix([min(keys), max(keys)]))))

        names = ["word", "n", "n_near", "form", "form_n"]
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
        ordered = dealt.select("word", "n", "key", "at", "part").repartition("part").sortWithinPartitions("part", "key")
        pairs = ordered.mapInArrow(lean(run), _NEAR)
        found = pairs if found is None else found.union(pairs)
    first = F.when(F.col("form").isNotNull(), F.struct(-F.col("form_n"), "form"))
    return found.groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min_by("form", first).alias("form"), F.max("form_n").alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form; a written table without nulls): the last word along the forms."""
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        longer = steps.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        longer = written(longer, "spelling-roots")
        drop(steps)
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        steps = longer


def spelling(documents: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, form_times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of documents."""
    bounded_batches(documents.sparkSession)
    counted = written(words(documents, least).filter(F.col("n") >= occurrences), "spelling-words")
    near = near_words(counted, least)
    clear = F.col("form_n") >= form_times * F.col("n")
    near = near.withColumns({"form": F.when(clear, F.col("form")), "form_n": F.when(clear, F.col("form_n"))})
    near = written(near, "spelling-near")
    drop(counted)
    ends = roots(near.filter("form is not null").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return spelling(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc_table() -> str:
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return "[" + ",".join(map(str, out)) + "]"


OP13_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w
  FROM documents),
c AS (SELECT doc_id, w, count(*) AS k, hex(encode(concat(coalesce(doc_id::VARCHAR, ''), ':', w))) AS x FROM r WHERE length(w) >= {LEAST} GROUP BY doc_id, w),
b AS (SELECT doc_id, w, k, list_transform(range(0, length(x) // 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT) AS bytes FROM c),
h AS (SELECT w, k, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda a, y: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, y) & 255) + 1]))) AS h FROM b),
t AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM t WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= {OCCURRENCES}),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
g AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN g.form_n >= {FORM_TIMES} * v.n THEN g.form END AS form,
         CASE WHEN g.form_n >= {FORM_TIMES} * v.n THEN g.form_n END AS form_n
  FROM v LEFT JOIN g USING (word)),
s AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON s.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e USING (word)
"""
