"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share of their union.

Exact and without all pairs:

1. Texts with equal sets form one class; only one text of a class goes on.
2. Stars: classes that share a minimum of one of four parts of their sets are compared with the smallest of them, so
   large groups of near copies become connected through few pairs.
3. Size-banded tiles: a class enters the tiles of the first shingles of its set in one global order, as many as
   guarantee that two linked sets meet in a tile.  Inside a tile, pairs of different components pass only if their
   sizes lie within the band of the threshold and the places of the shared shingle leave enough overlap.
   The order starts with hashes, but shingles of very many documents come last.  Tiles with very many components (a passage that many documents share) or many pairs for each row
   (a large group of near copies that the stars left in parts) are put off: their shingles move to the end
   of the order for the classes they touch, which meet again in tiles of rarer shingles.  Two classes that only meet
   in such a tile are both touched, so no link is lost.
   Classes of tiles that are still crowded after the last round are cut into blocks of bounded size, each of one size
   band.  Two blocks that share a crowded tile become one task, which compares their bitmaps; a pair of classes lies in
   one pair of blocks, so it is found once however many tiles it shares.
4. Hashed bitmaps of the candidates bound their overlap from above: a bit of one that the other lacks stands for a
   shingle outside the overlap.  Brief bitmaps go first, as they travel with every candidate; wide ones follow for the few
   pairs that pass.
5. Remaining pairs are decided by intersecting the sorted shingle arrays of their whole texts.
6. Links and stars give components by alternating large-star and small-star steps.

Defined results: null and empty texts have an empty set and are linked with nothing; texts of fewer than ``size``
words have their whole sequence as the only shingle; rows with the same doc_id are one node with the links of all
their texts; rows with a null doc_id are linked with nothing and have a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, id_filter, lean, mix, passes, slices, word_hashes, written
from .components import connected_components
from .ngram_counts import HELD, Sums

#: A tile with more components than this is put off to a round with its shingle last.
LARGE_TILE = 40
#: A shingle is a candidate for the end of the first order if one task meets it so often, and goes there if the tasks that
#: do so meet it more often than that together.  Rare shingles first make small tiles, so that few are put off.
CANDIDATE, COMMON = 2, 8
#: So is one that would give more candidate pairs than this for each of its rows, so that pairs grow as rows do and not as
#: the square of a group of near copies.
PAIRS_EACH = 2
#: So is one whose comparisons, or whose rows in a task's memory, would be more than this.
TILE_WORK, TILE_ROWS = 1 << 25, 1 << 20
#: Classes of a block of crowded tiles, about.
BLOCK = 1024
#: Most shingles that are moved to the end of the order, by the number of components in their tiles.
MOST_MOVED = 1 << 18
ROUNDS = 4


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes(texts)
    run = words.copy()
    if len(words) >= size:
        n = len(words) - size + 1
        k = words[:n]
        for j in range(1, size):
            k = mix(k * np.uint64(31) + words[j : j + n])
        run[:n] = k
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            k = words[a : a + 1]
            for j in range(a + 1, b):
                k = mix(k * np.uint64(31) + words[j : j + 1])
            out.append(mix(k + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


class Rule:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        """So many first shingles of n meet those of every linked set."""
        return n + (-self.percent * n // 100) + 1

    def needed(self, n, m):
        """Least intersection of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def fits(self, n, m):
        """Whether sizes leave room for a link."""
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


def bitmap(values: np.ndarray, bits_each: int = 4) -> bytes:
    """Which of so many or more bits a shingle are hit; widths are powers of two, so a wide one folds to a narrow one."""
    width = max(64, 1 << (bits_each * len(values) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[((values >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def overlap_bound(a: bytes, n: int, b: bytes, m: int) -> int:
    """No intersection of the sets behind two bitmaps is larger."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    width = min(len(x), len(y))
    x = np.bitwise_or.reduce(x.reshape(-1, width)) if len(x) > width else x
    y = np.bitwise_or.reduce(y.reshape(-1, width)) if len(y) > width else y
    only_x = int(np.bitwise_count(x & ~y).sum())
    only_y = int(np.bitwise_count(y & ~x).sum())
    return min(n - only_x, m - only_y)


def common_shingles(documents: DataFrame, size: int) -> np.ndarray:
    """Shingles of more than ``COMMON`` documents, ascending; at most ``MOST_MOVED``, the commonest.

    Any order of shingles gives the same links, so it does no harm that rare ones are left out task by task.
    """

    def run(batches):
        sums = Sums()

        def counted():
            keys, counts = sums.take(CANDIDATE)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for batch in batches:
            texts = batch.column(0)
            for first, last in slices(texts):
                sums.add(np.concatenate(shingle_sets(texts[first:last].to_pylist(), size)))
                if sums.held > HELD:
                    yield counted()
        yield counted()

    found = documents.select(F.col("text").cast("string")).mapInArrow(lean(run), "key long, n long")
    often = found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > COMMON)
    keys = often.orderBy(F.desc("n"), "key").limit(MOST_MOVED).select("key").toArrow().column("key")
    return np.sort(keys.to_numpy().view(np.uint64))


def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among ascending keys."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _ordered(s: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """A set's shingles in the order that has the moved ones last."""
    late = _among(s, moved)
    return np.concatenate([s[~late], s[late]])


def describe(documents: DataFrame, size: int, rule: Rule, moved: np.ndarray) -> DataFrame:
    """row, doc_id, n, key (of the set), mins, brief, bits, firsts: one pass over the texts.

    A row's number is its task's and its place there, so it is the same if the task runs again.  firsts: the first
    shingles in the order that has the moved ones last, about twice as many as the tiles need, so that most orders with crowded ones last are at hand.
    """
    schema = "row long, doc_id long, n long, key binary, mins array<long>, brief binary, bits binary, firsts array<long>"
    last_ones = documents.sparkSession.sparkContext.broadcast(moved)

    def rows(batches):
        seen = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                n, key, mins, brief, bits, firsts = [], [], [], [], [], []
                for s in shingle_sets(texts[first:last].to_pylist(), size):
                    n.append(len(s))
                    if not len(s):
                        key.append(None), mins.append(None), brief.append(None), bits.append(None), firsts.append(None)
                        continue
                    part = s & np.uint64(3)
                    hit = [(part == j).argmax() for j in range(4)]
                    key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    mins.append([int(s[i].view(np.int64)) if part[i] == j else None for j, i in enumerate(hit)])
                    brief.append(bitmap(s, 1)), bits.append(bitmap(s))
                    firsts.append(_ordered(s, last_ones.value)[: 2 * rule.prefix(len(s))].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(seen + first, seen + last)),
                        ids[first:last],
                        pa.array(n, pa.int64()),
                        pa.array(key, pa.binary()),
                        pa.array(mins, pa.list_(pa.int64())),
                        pa.array(brief, pa.binary()),
                        pa.array(bits, pa.binary()),
                        pa.array(firsts, pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n", "key", "mins", "brief", "bits", "firsts"],
                )
            seen += batch.num_rows

    read = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(lean(rows), schema)


_TILE = np.dtype([("key", "i8"), ("rep", "i8"), ("comp", "i8"), ("n", "i8"), ("pos", "i8")])


def _roomy(n, pos, m, at, rule: Rule):
    """Whether sizes and places of a shared shingle, the first one, leave room for a link."""
    return rule.fits(n, m) & (np.minimum(n - pos, m - at) >= rule.needed(n, m))


def _tile_pairs(t: np.ndarray, rule: Rule, large: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Candidate pairs of a tile's rows; None if it is to be put off.  Rows of the largest component are compared with
    those of the others alone."""
    comps, of, counts = np.unique(t["comp"], return_inverse=True, return_counts=True)
    main = of == counts.argmax()
    others = np.flatnonzero(~main)
    if len(comps) > large or len(others) * len(t) > TILE_WORK:
        return None
    a, b, left = [], [], PAIRS_EACH * len(t)
    for i in others.tolist():
        ok = _roomy(t["n"][i], t["pos"][i], t["n"], t["pos"], rule) & (of != of[i])
        ok[: i + 1] &= main[: i + 1]  # of two that are both not in the largest, the later row meets the earlier
        found = t["rep"][ok]
        left -= len(found)
        if left < 0:
            return None
        a.append(np.full(len(found), t["rep"][i])), b.append(found)
    return np.concatenate(a), np.concatenate(b)


def tiles(rows: DataFrame, rule: Rule, large: int) -> DataFrame:
    """Candidate pairs (a, b) of tile rows (key, rep, comp, n, pos); of put-off tiles their rows (key, a, null)."""

    def put_off(t: np.ndarray) -> np.ndarray:
        return np.stack([t["key"], t["rep"], np.full(len(t), -1)])

    def done(t: np.ndarray) -> list[np.ndarray]:
        """t: the rows of whole tiles, by key."""
        starts = np.flatnonzero(np.diff(t["key"], prepend=~t["key"][:1]))
        sizes = np.diff(np.append(starts, len(t)))
        mixed = np.minimum.reduceat(t["comp"], starts) != np.maximum.reduceat(t["comp"], starts)
        x, y = t[starts[mixed & (sizes == 2)]], t[starts[mixed & (sizes == 2)] + 1]
        ok = _roomy(x["n"], x["pos"], y["n"], y["pos"], rule)
        a, b, out = [x["rep"][ok]], [y["rep"][ok]], []
        for i, n in zip(starts[mixed & (sizes > 2)].tolist(), sizes[mixed & (sizes > 2)].tolist(), strict=True):
            found = _tile_pairs(t[i : i + n], rule, large)
            if found is None:
                out.append(put_off(t[i : i + n]))
            else:
                a.append(found[0]), b.append(found[1])
        a, b = np.concatenate(a), np.concatenate(b)
        return [*out, np.stack([np.zeros_like(a), np.minimum(a, b), np.maximum(a, b)])]

    def batch_of(out: list[np.ndarray]):
        key, a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b, mask=b == -1)], ["key", "a", "b"])

    def run(batches):
        held, count, late = [], 0, None  # rows of one key; the key whose rows are put off as they come
        for batch in batches:
            new = np.empty(batch.num_rows, dtype=_TILE)
            for name in _TILE.names:
                new[name] = batch.column(name).to_numpy(zero_copy_only=False)
            if late is not None:
                more = np.searchsorted(new["key"], late, side="right")  # keys ascend
                if more:
                    yield batch_of([put_off(new[:more])])
                new = new[more:]
            if not len(new):
                continue
            held.append(new)
            count += len(new)
            if held[0]["key"][0] != new["key"][-1]:
                whole = np.concatenate(held)
                cut = np.searchsorted(whole["key"], whole["key"][-1])
                yield batch_of(done(whole[:cut]))
                held, count = [whole[cut:]], len(whole) - cut
            if count > TILE_ROWS:
                late = new["key"][-1]
                yield batch_of([put_off(x) for x in held])
                held, count = [], 0
        if held:
            yield batch_of(done(np.concatenate(held)))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), "key long, a long, b long")


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one width, as rows of 64-bit words of a narrower or the same width (both in bytes)."""
    raw = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1, width)
    return np.ascontiguousarray(np.bitwise_or.reduce(raw, axis=1)).view(np.uint64)


def _block_pairs(x: dict, y: dict, same: bool, rule: Rule):
    """Places (i, j) of pairs of two blocks of different components whose sizes and bitmaps allow a link; blocks are
    dicts of arrays comp, n and a list bits.  same: both are one block, and j is after i."""
    widths = [np.array([len(b) for b in z["bits"]]) for z in (x, y)]
    for wide in np.unique(widths[0]).tolist():
        left = np.flatnonzero(widths[0] == wide)
        for other in np.unique(widths[1]).tolist():
            right = np.flatnonzero(widths[1] == other)
            width = min(wide, other)
            a = _folded([x["bits"][i] for i in left.tolist()], width)
            b = _folded([y["bits"][j] for j in right.tolist()], width)
            of_a, of_b = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (a, b))
            m, comp = y["n"][right], y["comp"][right]
            for k, i in enumerate(left.tolist()):
                n = x["n"][i]
                ok = rule.fits(n, m) & (comp != x["comp"][i])
                if same:
                    ok &= right > i
                at = np.flatnonzero(ok)
                if len(at):
                    both = np.bitwise_count(b[at] & a[k]).sum(axis=1, dtype=np.int64)
                    bound = np.minimum(n - (of_a[k] - both), m[at] - (of_b[at] - both))
                    at = at[bound >= rule.needed(n, m[at])]
                    yield np.full(len(at), i), right[at]


def block_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Candidate pairs (a, b) of rows (unit, side, rep, comp, n, bits): a unit is two blocks, or one if it has no side 1."""

    def done(unit: list[tuple]):
        sides = []
        for side in (0, 1):
            own = [r for r in unit if r[1] == side]
            ids = {name: np.array([r[k] for r in own], dtype=np.int64) for k, name in ((2, "rep"), (3, "comp"), (4, "n"))}
            sides.append(ids | {"bits": [r[5] for r in own]})
        x, y = sides
        same = not y["bits"]
        y = x if same else y
        found = list(_block_pairs(x, y, same, rule))
        a = np.concatenate([x["rep"][:0], *(x["rep"][i] for i, _ in found)])
        b = np.concatenate([x["rep"][:0], *(y["rep"][j] for _, j in found)])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    dealt = rows.select("unit", "side", "rep", "comp", "n", "bits").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(lean(run), "a long, b long")


def later_prefixes(firsts: DataFrame, rule: Rule, before: np.ndarray | None, moved: np.ndarray, fresh: np.ndarray | None) -> DataFrame:
    """rep, n, prefix of rows (rep, n, firsts) in the order that has the moved shingles (ascending) last; a null prefix
    where firsts do not reach so far.

    With fresh shingles only rows that have one of these in their prefix by the order before (the shingles that were
    last in it; none: the order of firsts), or may have.
    """
    arrays = firsts.sparkSession.sparkContext.broadcast((before, moved, fresh))

    def rows(batches):
        before, moved, fresh = arrays.value
        for batch in batches:
            shingles = batch.column(2)
            values = shingles.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            late = np.zeros(len(values), dtype=bool) if before is None else _among(values, before)
            later = _among(values, moved)
            new = None if fresh is None else _among(values, fresh)
            ends = np.cumsum(pc.list_value_length(shingles).to_numpy(zero_copy_only=False))
            sizes = batch.column(1).to_pylist()
            prefix, taken = [], np.ones(len(sizes), dtype=bool)
            for i, (n, a, b) in enumerate(zip(sizes, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                need = rule.prefix(n)
                if new is not None:
                    was = np.flatnonzero(~late[a:b])[:need]
                    taken[i] = len(was) < need or new[a:b][was].any()
                own = values[a:b][~later[a:b]][:need]
                prefix.append(own.view(np.int64) if len(own) == need else None)
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefix, pa.list_(pa.int64()))], ["rep", "n", "prefix"])
            yield found.filter(pa.array(taken))

    return firsts.select("rep", "n", "firsts").mapInArrow(lean(rows), "rep long, n long, prefix array<long>")


def moved_prefixes(texts: DataFrame, size: int, rule: Rule, moved: np.ndarray) -> DataFrame:
    """rep, n, prefix of texts in the order that has the moved shingles (ascending) last."""
    last_ones = texts.sparkSession.sparkContext.broadcast(moved)

    def rows(batches):
        late = last_ones.value
        for batch in batches:
            ids, contents = batch.column(0), batch.column(1)
            for first, last in slices(contents):
                n, prefix = [], []
                for s in shingle_sets(contents[first:last].to_pylist(), size):
                    n.append(len(s))
                    prefix.append(_ordered(s, late)[: rule.prefix(len(s))].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids[first:last], pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                    ["rep", "n", "prefix"],
                )

    return texts.mapInArrow(lean(rows), "rep long, n long, prefix array<long>")


class Join:
    """The tables of one join; see the module's text."""

    def __init__(self, documents: DataFrame, percent: int, size: int):
        self.spark, self.documents, self.size, self.rule = documents.sparkSession, documents, size, Rule(percent)
        self.moved = common_shingles(documents, size)
        self.sets = written(describe(documents, size, self.rule, self.moved), "shingle-sets")
        filled = self.sets.filter("n > 0 and doc_id is not null")
        first = F.min(F.struct("doc_id", "row"))
        self.classes = written(filled.groupBy("key").agg(first.alias("first")).select("key", "first.*"), "classes")
        # Rows of other texts of a class are few; only those that hit a bitmap of them go through the exact join.
        others = filled.select("row").join(self.classes.select("row"), "row", "left_anti")
        hit = passes(self.spark, id_filter(others, "row"), "row")
        own = filled.filter(~hit).union(filled.filter(hit).join(self.classes.select("row"), "row", "left_semi").select(*filled.columns))
        self.reps = written(own.select(F.col("doc_id").alias("rep"), "n", "mins", "brief", "bits", "firsts"), "class-sets")
        wide, self.sets = self.sets, written(self.sets.select("doc_id", "n", "key"), "set-keys")
        drop(wide)
        filled = self.sets.filter("n > 0 and doc_id is not null")
        self.members = filled.select("doc_id", "key").join(self.classes.select("key", F.col("doc_id").alias("rep")), "key")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(rep, text) of the given ids; few other texts get into the shuffle."""
        named = self.documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
        some = named.filter(passes(self.spark, id_filter(ids, "rep"), "rep"))
        return some.join(ids.select("rep"), "rep", "left_semi")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are links: bitmap bound, then exact intersection."""
        rule, size = self.rule, self.size

        def bounded(frames):
            for f in frames:
                ok = [
                    bool(rule.fits(n, m)) and overlap_bound(x, n, y, m) >= rule.needed(n, m)
                    for x, n, y, m in zip(f["x"], f["n"], f["y"], f["m"], strict=True)
                ]
                yield f.loc[ok, ["a", "b"]]

        def within(pairs: DataFrame, bits: DataFrame, step: str) -> DataFrame:
            met = pairs.join(bits.toDF("a", "n", "x"), "a").join(bits.toDF("b", "m", "y"), "b")
            return written(met.mapInPandas(lean(bounded), "a long, b long").distinct(), f"{name}-{step}")

        ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        close = within(pairs, self.reps.select("rep", "n", "brief"), "close")
        some = self.reps.filter(passes(self.spark, id_filter(ends(close), "rep"), "rep"))
        passed = within(close, some.select("rep", "n", "bits"), "bounded")
        drop(close)
        ids = ends(passed)
        texts = self.texts(ids)

        def exact(batches):
            for batch in batches:
                a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                keep = []
                mine, own = None, None
                for i in range(batch.num_rows):
                    x, y = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                    if mine != x:
                        mine, own = x, shingle_sets([x], size)[0]
                    other = shingle_sets([y], size)[0]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= rule.percent * (len(own) + len(other) - both))
                ok = np.array(keep, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

        whole = passed.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
        links = written(whole.mapInArrow(lean(exact), "a long, b long"), f"{name}-links")
        drop(passed)
        return links

    def star_pairs(self) -> DataFrame:
        """(a, b): the smallest class that has a minimum, and each other class that has it."""
        mins = self.reps.select("rep", F.posexplode("mins").alias("j", "m")).filter("m is not null")
        firsts = mins.groupBy("j", "m").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        return mins.join(firsts, ["j", "m"]).filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()

    def tile_pairs(self, comps: DataFrame) -> DataFrame:
        """Candidate pairs of classes in different components of the stars; comps: (id, component)."""
        named = comps.toDF("rep", "comp")
        moved, found = self.moved, []
        percent = F.lit(self.rule.percent)
        need = F.col("n") + F.floor(-percent * F.col("n") / 100).cast("long") + 1
        prefixes = self.reps.select("rep", "n", F.slice("firsts", F.lit(1), need.cast("int")).alias("prefix"))
        for turn in range(ROUNDS):
            whole = prefixes.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
            rows = whole.select("rep", "comp", "n", F.posexplode("prefix").alias("pos", "key"))
            rows = rows.select("key", "rep", "comp", "n", F.col("pos").cast("long"))
            out = written(tiles(rows, self.rule, LARGE_TILE), f"tiles-{turn}")
            found.append(out.filter("b is not null").select("a", "b"))
            put_off = out.filter("b is null")
            if turn == ROUNDS - 1:
                found.append(self.crowded_pairs(put_off.select("key", F.col("a").alias("rep")), named))
                break
            often = put_off.groupBy("key").count().orderBy(F.desc("count"), "key").limit(MOST_MOVED).select("key").toArrow()
            if not often.num_rows:
                break
            fresh = np.sort(often.column("key").to_numpy().view(np.uint64))
            before, moved, reps = moved if turn else None, np.union1d(moved, fresh), self.reps
            if len(fresh) == MOST_MOVED:  # there may be more of them, so who is touched is not known from the shingles
                reps, fresh = reps.join(put_off.select(F.col("a").alias("rep")).distinct(), "rep", "left_semi"), None
            later = written(later_prefixes(reps, self.rule, before, moved, fresh), "later-prefixes")
            short = later.filter("prefix is null").select("rep").distinct()
            prefixes = later.filter("prefix is not null").union(moved_prefixes(self.texts(short), self.size, self.rule, moved))
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out.distinct()

    def crowded_pairs(self, rows: DataFrame, named: DataFrame) -> DataFrame:
        """Candidate pairs of the classes (rep) of crowded tiles (key), block by block.

        A block holds classes of one size band that have the same commonest tile, and of one component where that
        fills a block.  So large groups of near copies make few blocks, whatever the number of tiles they share.
        """
        crowded = written(rows.distinct(), "crowded")
        popular = crowded.join(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key")
        heads = popular.groupBy("rep").agg(F.max(F.struct("c", "key"))["key"].alias("head"))
        width = math.log(max(100 / self.rule.percent, 1.01)) * (1 + 1e-9)  # sizes in the band are in the same band or the next
        cells = self.reps.select("rep", "n").join(heads, "rep").join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        cells = cells.withColumn("band", F.floor(F.log("n") / width).cast("int"))
        full = cells.groupBy("head", "band", "comp").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= BLOCK)
        cells = cells.join(full.select("head", "band", "comp", F.col("comp").alias("part")), ["head", "band", "comp"], "left")
        sums = cells.groupBy("head", "band", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
        same = (F.col("head") == F.col("h")) & (F.col("band") == F.col("b")) & F.col("part").eqNullSafe(F.col("p"))
        cells = cells.join(sums.toDF("h", "b", "p", "cuts"), same)
        block = F.xxhash64("head", "band", "part", F.pmod(F.xxhash64("rep"), F.col("cuts")))
        cells = written(cells.select("rep", "n", "comp", "band", "part", block.alias("block")), "blocks")
        met = written(crowded.join(cells, "rep").select("key", "block", "band", "part").distinct(), "blocks-met")
        left, right = met.toDF("key", "x", "x_band", "x_part"), met.toDF("key", "y", "y_band", "y_part")
        one_part = F.coalesce(F.col("x_part") == F.col("y_part"), F.lit(False))
        units = left.join(right, "key").filter((F.col("x") <= F.col("y")) & (F.abs(F.col("x_band") - F.col("y_band")) <= 1) & ~one_part)
        units = units.select("x", "y").distinct().withColumn("unit", F.xxhash64("x", "y"))
        sides = units.select("unit", F.lit(0).alias("side"), F.col("x").alias("block"))
        sides = sides.union(units.filter("x <> y").select("unit", F.lit(1).alias("side"), F.col("y").alias("block")))
        bits = cells.select("rep", "n", "comp", "block").join(self.reps.select("rep", "n", "bits"), ["rep", "n"])
        return written(block_pairs(sides.join(bits, "block"), self.rule), "tiles-crowded")

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        links = self.linked(self.star_pairs(), "stars")
        comps = connected_components(links)
        more = self.linked(self.tile_pairs(comps), "tiles")
        comps = connected_components(comps.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))
        # A node is a doc_id: rows of one id with several texts tie their classes together.
        least = self.members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).filter("a <> _most")
        ties = self.members.join(least, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
        if not ties.isEmpty():
            comps = connected_components(comps.select(F.col("component").alias("a"), F.col("id").alias("b")).union(ties))
        found = self.members.select("doc_id", "key", "rep").distinct().join(comps.toDF("rep", "component"), "rep", "left")
        found = found.select("doc_id", "key", F.coalesce("component", "rep").alias("component_id"))
        rest = self.sets.select("doc_id", "n", "key").join(found, ["doc_id", "key"], "left")
        return rest.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links."""
    return Join(documents, percent, size).components()


def one_of_each(documents: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """documents without all but the smallest id of each component; rows with a null id stay; all columns.

    Only rows that hit a bitmap of the dropped ids go through the exact join, so most texts are not shuffled.
    """
    found = near_duplicates(documents, percent, size).filter("doc_id <> component_id")
    gone = written(found.select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    hit = passes(documents.sparkSession, id_filter(gone, "_id"), "_doc")
    named = documents.withColumn("_doc", F.col("doc_id").cast("long"))
    kept = named.filter(~hit).union(named.filter(hit).join(gone, F.col("_doc") == F.col("_id"), "left_anti"))
    return kept.select(*documents.columns)


def op3_tiled_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 80 % of their five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingles
  FROM d),
x AS (SELECT r, doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s WHERE doc_id IS NOT NULL),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x AS a JOIN x AS b ON a.shingle = b.shingle AND a.r <> b.r
  GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(id, other) AS (
  SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION
  SELECT links.v, reached.other FROM reached JOIN links ON links.u = reached.id),
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT s.doc_id, len(s.shingles) AS n_shingles, component_id FROM s LEFT JOIN least ON s.doc_id = least.id
"""

__all__ = ["OP3_SQL", "Rule", "bitmap", "near_duplicates", "one_of_each", "op3_tiled_jaccard", "overlap_bound", "shingle_sets"]
