import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trekframe.llm import ngram_join
from trekframe.llm.common import id_filter, passes
from trekframe.llm.components import _print_of, connected_components
from trekframe.llm.exact_dedup import PatriciaTrie, deduplicate, owners
from trekframe.llm.ngram_join import bitmap, near_duplicates, one_of_each, overlap_bound, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return sorted(((i, len(s), top(i) if i is not None else None) for i, s in sets), key=str)


@pytest.mark.parametrize("large", [40, 2])
def test_components_match_brute_force(documents, rows, monkeypatch, large):
    monkeypatch.setattr(ngram_join, "LARGE_TILE", large)
    found = near_duplicates(documents).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)


@pytest.mark.parametrize(("large", "block", "held"), [(3, 8, 1 << 20), (3, 8, 20), (40, 1024, 1 << 20)])
def test_a_crowd_of_near_copies(spark, monkeypatch, large, block, held):
    """Copies of one text that each lack other words: most pairs of them are near the threshold, on both sides."""
    monkeypatch.setattr(ngram_join, "LARGE_TILE", large)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", held)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(words[: rng.randrange(90, 121)])))
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)
    assert 1 < len({r.component_id for r in found}) < 90


def test_very_many_edges_do_not_overflow(spark):
    edges = spark.range(1 << 25).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert _print_of(edges)[0] == 1 << 25


def test_an_id_ties_all_its_texts(spark):
    """Also those between its smallest and largest class, with their near copies."""
    texts = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcd"]
    rows = [(10 * (i + 1), t) for i, t in enumerate(texts)] + [(90, t) for t in texts] + [(70, f"{texts[1]} more"), (80, f"{texts[2]} more")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute_components(rows)
    assert {r.component_id for r in found} == {10}


def test_one_document_of_each_group_stays(documents, rows):
    kept = one_of_each(documents)
    assert kept.columns == documents.columns
    wanted = sorted((str(i), str(t)) for (i, t, *_) in rows if i is None or i in {c for x, _, c in brute_components(rows) if x == i})
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == wanted


def test_no_documents(nothing):
    assert near_duplicates(nothing).count() == one_of_each(nothing).count() == 0
    assert owners(nothing).count() == deduplicate(nothing).count() == 0


def test_bitmaps_bound_the_overlap():
    a, b = shingle_sets([" ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(20, 300))])
    both = len(set(a.tolist()) & set(b.tolist()))
    assert both <= overlap_bound(bitmap(a), len(a), bitmap(b), len(b)) < len(a)


def test_filter_passes_all_of_its_ids(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    bits = id_filter(ids, "k")
    assert len(bits) == (1 << 23) // 8 + 2 * 4096
    hit = spark.range(5000).withColumnRenamed("id", "k").filter(passes(spark, bits, "k"))
    found = {r.k for r in hit.collect()}
    assert set(range(0, 5000, 7)) <= found and len(found) < 800


def test_long_chains_become_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.union(spark.createDataFrame([(900, 901), (901, 901)], "a long, b long"))
    found = {r.id: r.component for r in connected_components(links).collect()}
    assert {found[i] for i in range(301)} == {0} and found[901] == 900


def test_trie_holds_prefixes_and_ties():
    trie, wanted = PatriciaTrie(), {}
    for i, key in enumerate([b"abc", b"ab", b"", b"abd", b"abc", b"b", b"abcdef", b"ab"]):
        trie.insert(key, (len(key), i, 1, 1))
        wanted.setdefault(key, []).append(i)
    found = dict(trie.spill())
    assert {k: (e[1], e[2]) for k, e in found.items()} == {k: (min(v), len(v)) for k, v in wanted.items()}
    assert not list(trie.spill()) and trie.held == 0


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_owners_match_brute_force(documents, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    found = owners(documents).collect()
    assert len(found) == len(rows)
    for r in found:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert (r.group_size, r.keep_id) == (len(groups[key]), min(groups[key])[2])
    assert sum(r.kept for r in found) == len(groups)


def test_dedup_keeps_one_row_of_each_text(documents, rows):
    kept = deduplicate(documents)
    assert kept.columns == documents.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(t) for _, t, *_ in rows})


def test_candidate_pairs_grow_as_the_rows_of_a_tile(spark):
    """A tile of one large component and some others gives few pairs for each row, or is put off as a whole."""
    for size in (6, 60, 600):
        rows = [(1, i, i + 1 if i < min(30, size // 2) else 0, 50, 0) for i in range(size)]
        out = ngram_join.tiles(spark.createDataFrame(rows, "key long, rep long, comp long, n long, pos long"), ngram_join.Rule(80), ngram_join.LARGE_TILE)
        assert out.count() <= ngram_join.PAIRS_EACH * size
        assert out.filter("b is null").select("a").distinct().count() in (0, size)
