import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from trekframe.llm import lm_scoring

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_scores(rows, order):
    lower = {i: i + 32 for i in range(65, 91)}
    texts = [WORD.findall((t or "").translate(lower)) for _, t, *_ in rows]
    counts = Counter(tuple(t[i : i + n]) for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(map(len, texts))
    out = []
    for (i, *_), t in zip(rows, texts, strict=True):
        score = 0.0
        for j in range(len(t)):
            gram = tuple(t[max(0, j - order + 1) : j + 1])
            score += math.log(counts[gram] / (counts[gram[:-1]] if gram[1:] else total))
        out.append((str(i), len(t), round(score, 6)))
    return sorted(out)


def same(found, wanted):
    assert [x[:2] for x in found] == [x[:2] for x in wanted]
    assert [x[2] for x in found] == pytest.approx([x[2] for x in wanted], abs=1e-4)


@pytest.mark.parametrize("most", [1 << 18, 4, 0])
def test_pairs_seen_once_count(documents, rows, monkeypatch, most):
    monkeypatch.setattr(lm_scoring, "HOT", most)
    found = lm_scoring.scores(documents).collect()
    same(sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in found), brute_scores(rows, 2))


@pytest.mark.parametrize(("order", "most"), [(3, 1 << 18), (3, 4), (3, 0), (4, 4)])
def test_longer_contexts_count(documents, rows, monkeypatch, order, most):
    """Also with texts that are shorter than a context."""
    monkeypatch.setattr(lm_scoring, "HOT", most)
    found = lm_scoring.scores(documents, order).collect()
    same(sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in found), brute_scores(rows, order))


def brute_under(rows, corpus, order):
    lower = {i: i + 32 for i in range(65, 91)}
    words = lambda t: WORD.findall((t or "").translate(lower))
    counts = Counter(tuple(t[i : i + n]) for t in map(words, corpus) for n in range(1, order + 1) for i in range(len(t) - n + 1))
    total = sum(n for gram, n in counts.items() if len(gram) == 1) or 1

    def value(gram):
        if len(gram) == 1:
            return (counts[gram] or 1) / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] else 0.4 * value(gram[1:])

    out = []
    for i, t, *_ in rows:
        t = words(t)
        out.append((str(i), len(t), round(sum(math.log(value(tuple(t[max(0, j - order + 1) : j + 1]))) for j in range(len(t))), 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_words_unknown_to_another_corpus_are_backed_off(documents, rows, order):
    corpus = [r for r in rows if r[0] is not None and r[0] % 3]
    found = lm_scoring.scores_under(documents, documents.filter("doc_id % 3 <> 0"), order).collect()
    same(sorted((str(r.doc_id), r.n_words, round(r.score, 6)) for r in found), brute_under(rows, [r[1] for r in corpus], order))


def test_no_text_to_score(nothing, spark):
    assert lm_scoring.scores(nothing).count() == lm_scoring.scores_under(nothing, nothing).count() == 0
    silent = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [(r.n_words, r.score, r["mean"]) for r in lm_scoring.scores(silent).collect()] == [(0, 0.0, None)] * 2


@pytest.mark.parametrize("name", ["op9_whole_backoff", "op9_whole_trigrams"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    found = con.sql(__spark_entry__.oracle_sql()[name])
    mine = __spark_entry__.queries()[name](spark, FOLDER).select(*found.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in mine.collect())
