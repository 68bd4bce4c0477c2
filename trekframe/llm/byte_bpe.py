"""Byte-level BPE: token ids of whole texts by a vocabulary of ranked byte strings, and the bytes that ids stand for.

Two tiers.  A text is split by the vocabulary's pattern, and the distinct matches of a run of texts are looked up at once
in a minimal perfect hash of the vocabulary: as many slots as tokens, a displacement for each bucket of keys, and one
comparison of bytes that tells a token from a stranger.  A match that is no token as a whole is merged: its bytes form a
linked list, a heap holds the ranks of neighbouring pairs, and the lowest rank (of equal ones the leftmost) is joined
first, which changes two other pairs.  That takes ``n log n`` steps for ``n`` bytes, so a match of a megabyte is no harm.

The hash is made once on the driver from the vocabulary (a file of fixed size) and broadcast; documents are read in place
and nothing is shuffled.  A run of texts is about a megabyte; a longer text is split as a stream, so a task holds a text,
its ids' text and its bytes.  What a worker has looked up or
merged is kept, up to ``MAX_MET`` matches and those of one run of texts.

Defined results: null counts as empty; an empty text has 0 tokens and the digests of nothing; repeated rows give a row each;
an empty table gives an empty result; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, lean, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct matches that a worker keeps with their ids; a run of texts that would exceed them starts anew.
MAX_MET = 250_000
#: Matches of a long text that are looked up together, and characters from which a text is long.
WINDOW, LONG = 1 << 17, 1 << 20
#: Mean keys of a bucket of the perfect hash, and displacements that are tried at once.
BUCKET, TRIES = 3, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks (which are the ids) of a vocabulary file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _digests(keys: list[bytes], seed: int) -> np.ndarray:
    """Three numbers of each key: for its bucket, its first slot and its step."""
    found = b"".join([xxhash.xxh3_128_digest(k, seed) for k in keys])
    words = np.frombuffer(found, dtype=">u4").reshape(-1, 4).astype(np.int64)
    return words[:, [0, 2, 3]]


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``slots(keys)`` has the place of each key, -1 for strangers."""

    def __init__(self, keys: list[bytes]):
        for self.seed in range(64):
            if self._built(keys):
                return
        raise ValueError("keys must be distinct")

    def _built(self, keys: list[bytes]) -> bool:
        n = len(keys)
        self.size, self.buckets = n, n // BUCKET + 1
        self.prime = next(p for p in range(max(n, 2), 4 * n + 8) if all(p % d for d in range(2, int(p**0.5) + 1)))
        bucket, first, step = self._numbers(keys) if n else np.zeros((3, 0), dtype=np.int64)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        taken, place = np.zeros(self.prime, dtype=bool), np.full(n, -1)
        taken[n:] = True  # a prime number of places, so that a step reaches all of them, of which so many are slots
        alone = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) == 1:
                alone.append((b, own[0]))
            if len(own) < 2:
                continue
            for start in range(0, self.prime, TRIES):
                slots = (first[own] + np.arange(start, start + TRIES)[:, None] * step[own]) % self.prime
                distinct = (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if len(good := np.flatnonzero(distinct & ~taken[slots].any(axis=1))):
                    self.shift[b] = start + good[0]
                    place[own] = slots[good[0]]
                    taken[place[own]] = True
                    break
            else:
                return False
        # A key that is alone in its bucket takes any free slot, which the bucket then names itself.
        for (b, key), slot in zip(alone, np.flatnonzero(~taken), strict=False):
            self.shift[b], place[key] = -1 - slot, slot
        self.keys = [keys[i] for i in np.argsort(place)]
        self.order = place
        return True

    def _numbers(self, keys: list[bytes]) -> np.ndarray:
        """Bucket, first place and step of each key."""
        found = _digests(keys, self.seed)
        return np.stack([found[:, 0] % self.buckets, found[:, 1] % self.prime, 1 + found[:, 2] % (self.prime - 1)])

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slots of many keys."""
        if not keys or not self.size:
            return [-1] * len(keys)
        bucket, first, step = self._numbers(keys)
        shift = self.shift[bucket]
        found = np.where(shift < 0, -1 - shift, (first + shift * step) % self.prime).tolist()
        mine, size = self.keys, self.size
        return [s if s < size and mine[s] == k else -1 for s, k in zip(found, keys, strict=True)]


class Codec:
    """encode(matches) and decode(ids) by a vocabulary, for distinct matches of a pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing}")
        tokens = list(ranks)
        self.ranks, self.hash, self.tokens = ranks, PerfectHash(tokens), {i: t for t, i in ranks.items()}
        self.ids = np.empty(len(tokens), dtype=np.int64)
        self.ids[self.hash.order] = list(ranks.values())
        self.ids = self.ids.tolist()
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])

    def _merge(self, data: bytes, rank: list[int], heap: list[int], bits: int) -> list[int]:
        """The ids of some bytes.  rank: of each byte's pair with the next (-1: none); heap: those ranks, each with its
        place in the lowest bits."""
        n, known, push, pop = len(data), self.ranks.get, heapq.heappush, heapq.heappop
        # Each part is named by where it begins; the next one begins where it ends.
        after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << bits) - 1
        while heap:
            i = (x := pop(heap)) & mask
            if rank[i] != x >> bits:  # one of the two parts has changed since
                continue
            j = after[i]
            k = after[i] = after[j]
            rank[j] = -1
            if k < n:
                before[k] = i
                r = rank[i] = known(data[i : after[k]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                r = rank[h] = known(data[h:k], -1)
                if r >= 0:
                    push(heap, r << bits | h)
        out, i, own = [], 0, self.ranks
        while i < n:
            out.append(own[data[i : (i := after[i])]])
        return out

    def merged(self, matches: list[bytes]) -> list[list[int]]:
        """The ids of matches that are no tokens as a whole."""
        if not matches:
            return []
        sizes = np.array(list(map(len, matches)))
        data = np.frombuffer(b"".join(matches), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(sizes)), sizes)
        ranks = np.append(self.pairs[data[:-1] << 8 | data[1:]], -1)
        ranks[ends - 1] = -1
        bits = int(sizes.max()).bit_length()
        some = np.flatnonzero(ranks >= 0)
        keys = ranks[some] << bits | (some - (ends - sizes)[of[some]])
        keys = keys[np.lexsort((keys, of[some]))].tolist()  # a sorted list is a heap
        last = np.cumsum(np.bincount(of[some], minlength=len(sizes))).tolist()
        ranks, ends, out, i, k = ranks.tolist(), ends.tolist(), [], 0, 0
        for match, j, m in zip(matches, ends, last, strict=True):
            out.append(self._merge(match, ranks[i:j], keys[k:m], bits))
            i, k = j, m
        return out

    def encode(self, matches: list[bytes]) -> list[list[int]]:
        """The ids of each match."""
        ids, slots = self.ids, self.hash.slots(matches)
        merged = iter(self.merged([m for m, s in zip(matches, slots, strict=True) if s < 0]))
        return [[ids[s]] if s >= 0 else next(merged) for s in slots]

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _windows(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The matches of a text in turn, a bounded number at a time if it is long."""
    if len(text) < LONG:
        yield pattern.findall(text)
        return
    found = pattern.finditer(text)
    while window := [m[0] for m in islice(found, WINDOW)]:
        yield window


class Met:
    """The matches that a worker has met lately: their ids as text, and the bytes that the ids decode to."""

    def __init__(self, codec: Codec):
        self.codec, self.written, self.decoded = codec, {}, {}

    def add(self, matches: set[str]) -> None:
        new = list(matches - self.written.keys())
        if len(self.written) + len(new) > MAX_MET:
            self.written, self.decoded, new = {}, {}, list(matches)
        ids = self.codec.encode([m.encode("utf-8") for m in new])
        self.written.update(zip(new, [" ".join(map(str, x)) for x in ids], strict=True))
        self.decoded.update(zip(new, map(self.codec.decode, ids), strict=True))


def digests(met: Met, pattern: regex.Pattern, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    short = {i: pattern.findall(t) for i, t in enumerate(texts) if len(t) < LONG}
    met.add(set(chain.from_iterable(short.values())))
    for i, text in enumerate(texts):
        n, written, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for window in [short[i]] if i in short else _windows(pattern, text):
            if not window:
                continue
            if i not in short:
                met.add(set(window))
            ids = " ".join(map(met.written.__getitem__, window))
            written.update((" " * (n > 0) + ids).encode())
            decoded.update(b"".join(map(met.decoded.__getitem__, window)))
            n += ids.count(" ") + 1
        yield n, written.hexdigest(), decoded.hexdigest()


_patterns: dict[str, regex.Pattern] = {}


def encoded(documents: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by spaces) and decoded_sha256 for every row."""
    bounded_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if pattern not in _patterns:
            _patterns[pattern] = regex.compile(pattern)
        met = Met(held.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                rows = digests(met, _patterns[pattern], [t or "" for t in texts[first:last].to_pylist()])
                n, written, decoded = zip(*rows, strict=True)
                columns = [ids[first:last], pa.array(n, pa.int64()), pa.array(written), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), schema)


def token_ids(documents: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every row, for those who train on them."""
    bounded_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary)))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        if pattern not in _patterns:
            _patterns[pattern] = regex.compile(pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                out = []
                for text in texts[first:last].to_pylist():
                    parts = []
                    for window in _windows(_patterns[pattern], text or ""):
                        distinct = list(set(window))
                        known = dict(zip(distinct, held.value.encode([m.encode("utf-8") for m in distinct]), strict=True))
                        parts += chain.from_iterable([known[m] for m in window])
                    out.append(parts)
                yield pa.RecordBatch.from_arrays([ids[first:last], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id {kind}, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and data (binary): the bytes that ids (doc_id, ids: array of int) stand for; null counts as no ids."""
    held = ids.sparkSession.sparkContext.broadcast(Codec(read_ranks(vocabulary)))

    @F.pandas_udf("binary")
    def joined(each):
        return each.map(lambda x: b"" if x is None else held.value.decode([int(i) for i in x]))

    return ids.select("doc_id", joined("ids").alias("data"))


def op12_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the byte-level BPE ids of every document, and of what they decode to."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
