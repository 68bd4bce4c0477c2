"""Words that collide in polynomial hashes, and tables in which one id has most of the rows."""

import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trekframe.llm import common, language_id, lm_scoring, ngram_join, packing, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, rank int"


def thue_morse(n):
    """Two words of n letters that collide under every polynomial hash modulo a power of two up to 2 ** 64."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


ONE, TWO = thue_morse(2048)


def row(doc_id, text, lang=None, source=None):
    return (doc_id, text, lang, source, len(text or ""), 0.0, "", 0)


def test_hashes_tell_constructed_words_apart():
    hashes, bounds = common.word_hashes([f"{ONE} x {TWO}", None, "", ONE.upper()])
    assert bounds.tolist() == [0, 3, 3, 3, 4]
    assert hashes[0] != hashes[2] and hashes[0] == hashes[3]


def test_words_are_split_and_lower_cased_at_the_given_characters_alone():
    words, bounds = common.words_of(["A\x1cB C\tÄ\x0bx\x85y", " \n", None])
    assert words == ["a\x1cb c".encode(), "Ä".encode(), "x\x85y".encode()] and bounds.tolist() == [0, 3, 3, 3]
    assert common.words_of(["AB c"], lower=False)[0] == [b"AB", b"c"]


def test_ids_of_constructed_words_are_their_own():
    path = public_tokenizers.path(packing.TOKENIZER)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    found = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path).encode([ONE, TWO, f"{ONE} {TWO}"])]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in (ONE, TWO, f"{ONE} {TWO}")] and found[0] != found[1]


def test_texts_of_constructed_words_are_neither_linked_nor_mixed_up(spark):
    docs = spark.createDataFrame([row(1, ONE), row(2, TWO), row(3, f"{ONE} b c d e f"), row(4, f"{TWO} b c d e f")], SCHEMA)
    components = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert components == {1: 1, 2: 2, 3: 3, 4: 4}
    crc = {r.doc_id: r.ids_crc32 for r in packing.pack(docs, public_tokenizers.path(packing.TOKENIZER)).collect()}
    assert crc[1] != crc[2] and crc[3] != crc[4]
    # Were the two words one, it would be met four times.
    pair = spark.createDataFrame([row(1, ONE), row(2, f"{TWO} {TWO} {TWO}")], SCHEMA)
    scored = {r.doc_id: r.score for r in lm_scoring.scores(pair).collect()}
    assert scored[1] == pytest.approx(math.log(1 / 4)) and scored[2] == pytest.approx(math.log(3 / 4) + 2 * math.log(2 / 3))


@pytest.mark.parametrize("hot", [1, 5_000_001])
def test_an_id_with_most_of_a_language_neither_loses_nor_fills_it(spark, hot):
    english = [row(hot, f"the weather of the day number {i} was good and the people were out there with the others", "en") for i in range(1500)]
    german = [row(10_000 + i, f"das Wetter an dem Tag {i} war schlecht und die Leute sind nicht nach draußen gegangen", "de") for i in range(150)]
    docs = spark.createDataFrame([*english, *german, *([german[0]] * 1000)], SCHEMA).repartition(4)
    training = docs.filter("lang is not null")
    drawn = {r["lang"]: r["count"] for r in language_id._sampled(training, 100).groupBy("lang").count().collect()}
    assert 60 < drawn["en"] < 150 and 60 < drawn["de"] < 150
    model = language_id.fit(docs, F.lit(True), sample=100)
    found = language_id.identify(docs.select("doc_id", "text", "lang"), model)
    assert found.filter("lang_pred <> lang").isEmpty()


def test_toxicity_learns_from_a_bounded_number_of_rows_of_an_id(spark, monkeypatch):
    met = []
    real = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: met.append((name, t := real(df, name))) or t)
    docs = [row(1, f"you stupid idiot number {i} shut up") for i in range(600)] + [row(1, "you stupid idiot")] * 300 + [row(2 + i, f"a fine day number {i}") for i in range(80)]
    labels = spark.createDataFrame([(1, 1), *((2 + i, 0) for i in range(80))], "doc_id long, toxic int")
    documents = spark.createDataFrame(docs, SCHEMA).select("doc_id", "text")
    model = toxicity.fit(documents, labels, F.lit(True), sample=50)
    [rows] = [t for name, t in met if name == "toxicity-texts"]
    assert rows.filter("label = 1").count() < 100 and rows.count() == rows.distinct().count()
    scored = model.score(documents.withColumn("score", F.lit("mine")))
    assert scored.count() == len(docs) and scored.filter("score between 0 and 1").count() == len(docs)
