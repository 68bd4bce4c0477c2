"""Exact dedup: Patricia-trie owners.

Texts are equal when they are identical after deleting white space.  Every task first merges the copies inside its own
blocks, so a text that fills a third of the table enters the shuffle once a block.  What is left is partitioned by
length and content hash and ordered by them; each task inserts the full byte strings into a compressed radix trie,
whose terminal nodes hold the owner (most code points, then smallest id) and the number of rows.  Equal strings have
equal length and hash and so arrive together: whenever the trie outgrows its bound at the edge of a (length, hash)
run, its subtrees are finished, leave as rows of the result and are freed.  Memory is bounded by that limit and the
longest single run.

Defined results: null counts as empty; null ids are owners only where no other row is as long; rows that repeat both
id and text are rows of their group, one of them stays; an empty table gives an empty result; other columns are
ignored by ``owners`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, lean, slices, text_hash, without, written

_SPACES = SPACE_CHARS.encode()
#: Bytes of text that a task's trie may hold at the edge of a run.
TRIE_BYTES = 8 << 20


class _Node:
    __slots__ = ("edges", "entry")

    def __init__(self, entry=None):
        self.edges: dict[int, list] = {}
        self.entry = entry


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of label and key[at:]."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _better(a: tuple, b: tuple) -> bool:
    """Whether owner a = (code points, id) stays rather than b."""
    if a[0] != b[0]:
        return a[0] > b[0]
    if a[1] is None or b[1] is None:
        return b[1] is None and a[1] is not None
    return a[1] < b[1]


def merged(old: list, new: tuple) -> None:
    """old: [chars, id, rows, rows that tie with the owner]; takes in another such entry."""
    if old[:2] == list(new[:2]):
        old[3] += new[3]
    elif _better(new, old):
        old[0], old[1], old[3] = new[0], new[1], new[3]
    old[2] += new[2]


class PatriciaTrie:
    """A compressed radix trie over byte strings with an entry at each terminal node."""

    def __init__(self):
        self.root, self.held = _Node(), 0

    def insert(self, key: bytes, entry: tuple) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                node.edges[key[at]] = [key[at:], _Node(list(entry))]
                self.held += len(key) - at
                return
            label, child = edge
            if not key.startswith(label, at):
                k = _common(label, key, at)
                middle = _Node()
                middle.edges[label[k]] = [label[k:], child]
                edge[0], edge[1] = label[:k], middle
                child = middle
                at += k
            else:
                at += len(label)
            node = child
        if node.entry is None:
            node.entry = list(entry)
        else:
            merged(node.entry, entry)

    def spill(self):
        """(key, entry) of every terminal node, subtree by subtree; each subtree is freed as it goes."""
        if self.root.entry is not None:
            yield b"", self.root.entry
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            for label, child in node.edges.values():
                if child.entry is not None:
                    yield prefix + label, child.entry
                if child.edges:
                    stack.append((prefix + label, child))
            node.edges = {}
        self.root, self.held = _Node(), 0


def _merge_blocks(batches):
    """Copies inside a block become one row: length, hash, string and entry."""
    for batch in batches:
        ids, chars, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
        for first, last in slices(texts, 4 << 20):
            found: dict[bytes, list] = {}
            for i, n, t in zip(ids[first:last].to_pylist(), chars[first:last].to_pylist(), texts[first:last].to_pylist(), strict=True):
                key = (t or b"").translate(None, _SPACES)
                if key in found:
                    merged(found[key], (n, i, 1, 1))
                else:
                    found[key] = [n, i, 1, 1]
            keys, entries = list(found), list(found.values())
            hashes = [int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(k) for k in keys], pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())]
                + [pa.array([e[j] for e in entries], pa.int64()) for j in range(4)],
                ["bytes", "hash", "key", "chars", "id", "n", "ties"],
            )


def _trie_owners(batches):
    """Rows in the order of (bytes, hash) in; a row for each distinct string out."""
    trie, run = PatriciaTrie(), None

    def rows():
        out = [(hashlib.sha256(k).digest(), *e) for k, e in trie.spill()]
        columns = list(zip(*out, strict=True))
        kinds = [pa.binary(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["sha", "best_chars", "keep_id", "group_size", "ties"]
        )

    for batch in batches:
        columns = [batch.column(j) for j in range(7)]
        for first, last in slices(columns[2], 4 << 20):
            for size, h, key, *entry in zip(*(c[first:last].to_pylist() for c in columns), strict=True):
                if run != (size, h):
                    if trie.held > TRIE_BYTES:
                        yield rows()
                    run = (size, h)
                trie.insert(key, tuple(entry))
    if run is not None:
        yield rows()


def _digests(batches):
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        out = []
        for first, last in slices(texts, 4 << 20):
            out += [hashlib.sha256((t or b"").translate(None, _SPACES)).digest() for t in texts[first:last].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "chars", "text_hash", "sha"]
        )


def owners(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, keep_id, group_size, kept and text_sha256 for every row of documents (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = documents.select(
        F.col("doc_id").cast("long"), F.length(text).cast("long").alias("chars"), text_hash().alias("text_hash"), text.alias("text")
    )
    blocks = named.select("doc_id", "chars", "text").mapInArrow(
        lean(_merge_blocks), "bytes long, hash long, key binary, chars long, id long, n long, ties long"
    )
    dealt = blocks.repartition("bytes", "hash").sortWithinPartitions("bytes", "hash")
    found = written(
        dealt.mapInArrow(lean(_trie_owners), "sha binary, best_chars long, keep_id long, group_size long, ties long"), "dedup-owners"
    )
    digests = named.mapInArrow(lean(_digests), "doc_id long, chars long, text_hash long, sha binary")
    digests = written(digests.withColumn("row", F.monotonically_increasing_id()), "dedup-digests")
    groups = found.filter("group_size > 1")
    rows = digests.join(groups, "sha", "left").withColumn(
        "kept", F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars")))
    )
    if not groups.filter("ties > 1").isEmpty():  # rows that repeat the owner's id and text: the first of them stays
        firsts = rows.filter("kept and ties > 1").groupBy("sha").agg(F.min("row").alias("first"))
        rows = rows.join(firsts, "sha", "left").withColumn("kept", F.col("kept") & (F.col("first").isNull() | (F.col("row") == F.col("first"))))
    return rows.select(
        "doc_id",
        "text_hash",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(documents: DataFrame) -> DataFrame:
    """documents without all but one row of each group of equal texts; all columns."""
    return without(documents, written(owners(documents).select("doc_id", "text_hash", "kept"), "dedup-kept"))


def op6_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and the fate of every document."""
    found = owners(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Hashes and lengths are SQL's own; translate() deletes the white space.
OP6_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
           FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
