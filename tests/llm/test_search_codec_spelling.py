"""Ranked search, byte-level BPE and spelling variants held to brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import public_tokenizers
import tiktoken

from trekframe.llm import byte_bpe, queries, ranked_search, spelling
from trekframe.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, rank int"

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, rank int, row string, term string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, best=50):
    docs = [(r[0], terms_of(r[1])) for r in rows]
    docs = [d for d in docs if d[1]]
    n_docs, n_all = len(docs), sum(len(t) for _, t in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item in items:
        scores = []
        for doc_id, ts in docs:
            m, tf, score = 50 + (50 * len(ts) * n_docs) // n_all, Counter(ts), 0
            for t in set(terms_of(item[1])) & tf.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item[0], k, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:best], 1)]
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def items(spark, rows):
    rng = random.Random(3)
    texts = [" ".join(rng.sample(r[1].split(), min(12, len(r[1].split())))) for r in rows if r[1] and r[1].split()][:40]
    texts += [None, "", " - ", "absent words only xyzzy", "ONE Two one", "日本 Ä", texts[0]]
    found = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(0, texts[0], 1, "x", "y"), (None, texts[1], 1, "x", "y")]
    return found


def result(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def test_search_is_exact(spark, rows, items, documents):
    found = ranked_search.search(documents, spark.createDataFrame(items, ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(found) == brute_search(rows, items)


@pytest.mark.parametrize("best", [1, 3])
def test_search_with_thresholds_that_prune(spark, rows, items, documents, best):
    assert result(ranked_search.search(documents, spark.createDataFrame(items, ITEMS), best)) == brute_search(rows, items, best)


def test_search_in_several_passes_joins_and_parts(spark, rows, items, documents, monkeypatch):
    for name, value in (("MOST_TERMS", 7), ("LIST_ROWS", 5), ("WINDOW", 16)):
        monkeypatch.setattr(ranked_search, name, value)
    assert result(ranked_search.search(documents, spark.createDataFrame(items, ITEMS), 4)) == brute_search(rows, items, 4)


def test_search_of_nothing(spark, nothing, items, documents):
    asked = spark.createDataFrame(items, ITEMS)
    assert ranked_search.search(nothing, asked).count() == 0
    assert ranked_search.search(documents, asked.limit(0)).count() == 0


def test_a_term_longer_than_a_window_stays_whole(monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 8)
    text = "a bb " + "c" * 50 + " dd e" + "f" * 9
    assert [t for w in ranked_search.windows(text.encode()) for t in w] == text.encode().split()


@pytest.fixture(scope="module")
def tokenizer():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def codec_row(tokenizer, doc_id, text):
    ids = tokenizer.encode_ordinary(text or "")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode()))


ODD = ["don't I'll 'S", "  two\n\n three \t", " x　y\u0085z", "日本語 ½ ² ١٢ 🙂🙂", "x" * 3000, "ab" * 700, "<|endoftext|>", "\r\n" * 9 + "!", "é́ ǅ ⅷ", "0123456789" * 40]


def test_encoding_agrees_with_the_library(spark, rows, documents, tokenizer, monkeypatch):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    odd = [(i, t, None, None, 0, 0.0, "", 0) for i, t in enumerate(ODD)]
    every = documents.union(spark.createDataFrame(odd, SCHEMA))
    wanted = sorted(str(codec_row(tokenizer, r[0], r[1])) for r in rows + odd)
    assert sorted(str(tuple(r)) for r in byte_bpe.encoded(every, path).collect()) == wanted
    ids = byte_bpe.token_ids(every, path)
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids.collect()) == sorted((str(r[0]), tokenizer.encode_ordinary(r[1] or "")) for r in rows + odd)
    back = sorted((str(r.doc_id), bytes(r.data)) for r in byte_bpe.decoded(ids, path).collect())
    assert back == sorted((str(r[0]), (r[1] or "").encode()) for r in rows + odd)


def test_long_texts_and_full_stores_give_the_same(tokenizer, monkeypatch):
    import regex

    codec = byte_bpe.Codec(byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)))
    texts = [" ".join(ODD), *ODD, ""]
    for name, value in (("LONG", 40), ("WINDOW", 3), ("MAX_MET", 5)):
        monkeypatch.setattr(byte_bpe, name, value)
    for text in texts:  # a long text is alone in its run
        [found] = byte_bpe.digests(byte_bpe.Met(codec), regex.compile(public_tokenizers.PATTERN), [text])
        assert found == codec_row(tokenizer, 0, text)[1:]


def test_encoding_of_nothing(nothing):
    assert byte_bpe.encoded(nothing, public_tokenizers.path(byte_bpe.VOCABULARY)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_hash_is_perfect_and_minimal(n):
    keys = [f"key {i}".encode() for i in range(n)]
    found = byte_bpe.PerfectHash(keys).slots(keys + [b"stranger", b""])
    assert sorted(found[:n]) == list(range(n)) and found[n:] == [-1, -1]


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_words(rows, least, occurrences, typo=199):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def brute_forms(counts, times=5):
    out, form = {}, {}
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out[w] = (n, len(found))
    rows = []
    for w, (n, k) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, k, counts.get(form[w])))
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(11)
    stems = ["conversation", "translator", "landschaft", "überall", "niñería", "banana", "bananas", "aaaaaa", "aaaaaaa", "abababab", "mississippi"]
    stems += ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 9))) for _ in range(120)]
    out = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = stems[min(int(rng.paretovariate(0.6)) - 1, len(stems) - 1)]
            if rng.random() < 0.2:
                at, c = rng.randrange(len(w)), rng.choice("abcdé")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "-", "1"]).join(words), None, None, 0, 0.0, "", 0))
    return out


def test_spelling(spark, rows, misspelt, documents):
    every = documents.union(spark.createDataFrame(misspelt, SCHEMA).repartition(5))
    found = spelling.spelling(every)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = brute_forms(brute_words(rows + misspelt, 6, 5))
    assert sorted(str(tuple(r)) for r in found.collect()) == wanted
    assert sum("None, None" not in w for w in wanted) > 20


@pytest.mark.parametrize("cell_words", [1, 4, 30])
def test_cut_tries_meet_all_pairs(spark, misspelt, cell_words):
    counts = brute_words(misspelt, 6, 1)
    table = written(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    found = {r.word: (r.n, r.n_near, r.form) for r in spelling.near_words(table, 6, cell_words).collect()}
    wanted = {}
    for w in counts:
        near_ones = [x for x in counts if near(w, x)]
        wanted[w] = (counts[w], len(near_ones), min(near_ones, key=lambda x: (-counts[x], x), default=None))
    assert found == wanted


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(21)]
    table = written(spark.createDataFrame(chain, "word string, form string"), "forms")
    assert {r.word: r.root for r in spelling.roots(table).collect()} == {w: "w21" for w, _ in chain}


def test_spelling_of_nothing_and_of_long_texts(spark, nothing, monkeypatch):
    assert spelling.spelling(nothing).count() == 0
    monkeypatch.setattr(spelling, "LONG", 10)
    monkeypatch.setattr(spelling, "HELD", 3)
    long = "Wanderung " * 50 + "y" * 5000 + " Wandrung" * 6
    rows = [(i, long, None, None, 0, 0.0, "", 0) for i in (1, 1, 2, None, 3)]
    found = spelling.spelling(spark.createDataFrame(rows, SCHEMA))
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_forms(brute_words(rows, 6, 5))


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_tput_search", "op13_trie_variants", "op9_under_conversations"])
def test_sql_agrees(spark, name):
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    wanted = con.sql(queries.ORACLE_SQL[name])
    mine = queries.QUERIES[name](spark, FOLDER)
    assert sorted(mine.columns) == sorted(wanted.columns)
    assert sorted(str(tuple(r)) for r in mine.select(*wanted.columns).collect()) == sorted(map(str, wanted.fetchall()))


def test_encoding_query_agrees_with_the_library(spark, tokenizer):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    mine = queries.QUERIES["op12_two_tier_bpe"](spark, FOLDER)
    assert sorted(tuple(r) for r in mine.collect()) == sorted(codec_row(tokenizer, *r) for r in texts)
