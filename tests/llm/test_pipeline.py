import math
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_reaches_its_end(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "best-fit packing",
    ]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3]
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def shingle_set(text):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(docs):
    """The smallest doc_id reachable by links, by comparing all pairs."""
    sets, top = {r.doc_id: shingle_set(r.text) for r in docs}, {r.doc_id: r.doc_id for r in docs}

    def head(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((head(i), head(j)))
                top[y] = x
    return {i: head(i) for i in ids}


def goals(words):
    """Shares of 150 % by weight, at most twice a source; a common level found by halving."""
    names = sorted(x for x in words if x is not None) + [None] * (None in words)
    weight, total = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}, 1.5 * sum(words.values())
    low, high = 0.0, 2.0 * sum(words.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * words[x], level * weight[x]) for x in names) < total else (low, level)
    return {x: min(2 * words[x], low * weight[x]) for x in names}


def test_stages_match_brute_force(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: (df.cache(), df.collect())
    known, rows = read(stages["language ID"](spark, docs, FOLDER))
    everything = docs.collect()
    left = {r.doc_id for r in everything} - {r.doc_id for r in rows}
    assert all(not any(c.isalpha() for c in r.text or "") or r.lang is None for r in everything if r.doc_id in left)
    assert all(any(c.isalpha() for c in r.text) for r in rows)

    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    once, rows = read(stages["exact dedup"](spark, known, FOLDER))
    assert sorted(r.doc_id for r in rows) == sorted(min(g)[1] for g in groups.values())

    heads = components(rows)
    apart, rows = read(stages["n-gram Jaccard join"](spark, once, FOLDER))
    assert sorted(r.doc_id for r in rows) == sorted(i for i, h in heads.items() if i == h)

    words = defaultdict(int)
    for r in rows:
        words[r.source] += len(WORD.findall(r.text))
    kept = {r.doc_id: r for r in rows}
    mixed, rows = read(stages["mixing to target weights"](spark, apart, FOLDER))
    taken = defaultdict(int)
    for r in rows:
        assert r == kept[r.doc_id]
        taken[r.source] += len(WORD.findall(r.text))
    copies = Counter(r.doc_id for r in rows)
    assert max(copies.values()) <= 2
    for source, goal in goals(words).items():  # no copy more or less of any document would come nearer from the same side
        sizes = {r.doc_id: len(WORD.findall(r.text)) for r in kept.values() if r.source == source}
        more = [n for i, n in sizes.items() if n and copies[i] < 2]
        less = [n for i, n in sizes.items() if n and copies[i]]
        assert taken[source] - min(less, default=0) - 1e-6 <= goal <= taken[source] + min(more, default=0) + 1e-6

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    pieces = stages["best-fit packing"](spark, mixed, FOLDER).collect()
    wanted = Counter()
    for n, times in lengths.items():
        wanted.update({4096: n // 4096 * times, n % 4096: times})
    assert Counter(p.length for p in pieces) == +Counter({n: t for n, t in wanted.items() if n})
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 4096
    assert len(bins) <= math.ceil(sum(p.length for p in pieces) / 4096) + 2


def test_pipeline_of_nothing(spark):
    nothing = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).withColumn("rank", F.lit(1)).withColumn("row", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, nothing, FOLDER)
        assert found.count() == 0, name
        assert name == "best-fit packing" or found.columns == nothing.columns


@pytest.mark.parametrize("name", ["op3_tiled_jaccard", "op6_patricia_owners", "op8_targets", "op9_stupid_backoff"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.sql(__spark_entry__.oracle_sql()[name])
    mine = __spark_entry__.queries()[name](spark, FOLDER).select(*found.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in mine.collect())


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names
