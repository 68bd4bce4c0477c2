import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trekframe.llm import language_id, mixing, quality_rules, toxicity
from trekframe.llm.common import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_copies(sizes, rates):
    """One document after the other: the floor of its rate or one more, then what is still owed."""
    copies, owed = [], 0.0
    for size, rate in zip(sizes, rates, strict=True):
        least = math.floor(rate)
        owed += (rate - least) * size
        more = rate > least and size > 0 and owed > size / 2
        copies.append(least + more)
        owed -= size * more
    for i, size in enumerate(sizes):
        if 0 < size <= owed and copies[i] + 1 <= 2:
            copies[i], owed = copies[i] + 1, owed - size
        elif 0 < size <= -owed and copies[i]:
            copies[i], owed = copies[i] - 1, owed + size
    return copies, owed


def test_rounding_matches_one_document_after_the_other():
    rng = random.Random(8)
    for _ in range(200):
        sizes = sorted((rng.randrange(0, 60) for _ in range(rng.randrange(1, 40))), reverse=True)
        rates = [2 * rng.random() for _ in sizes]
        wanted, owed = brute_copies(sizes, rates)
        assert mixing.round_rates(sizes, rates, [1] * len(sizes), 2.0) == wanted
        # The same rows as groups take as many words, but for what one document of the smallest size can change.
        groups = sorted(set(zip(sizes, rates, strict=True)), reverse=True)
        times = [sum(x == g for x in zip(sizes, rates, strict=True)) for g in groups]
        grouped = mixing.round_rates([s for s, _ in groups], [r for _, r in groups], times, 2.0)
        assert all(0 <= c <= 2 * n for c, n in zip(grouped, times, strict=True))
        assert abs(sum(s * c for (s, _), c in zip(groups, grouped, strict=True)) - sum(s * c for s, c in zip(sizes, wanted, strict=True))) <= 2 * max(sizes)


def test_a_row_repeated_very_often_is_mixed_whole(spark):
    rows = [(1, "a b c d e f g", "x")] * 400 + [(i, "w " * (i % 9 + 1), "xyz"[i % 3]) for i in range(2, 200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(documents).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 2 for r in found)
    assert len({r.copies for r in found if r.doc_id == 1}) <= 2
    taken, targets = Counter(), {r.source: r.target for r in found}
    for r in found:
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - t) <= 4 for s, t in targets.items())
    kept = mixing.mixed_documents(documents)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == +Counter({i: sum(r.copies for r in found if r.doc_id == i) for i in {r.doc_id for r in found}})


def brute_targets(sizes, share=1.5):
    """Shares by weight, excess shared again, round after round."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while left > 1e-9:
        open_ones = [s for s in names if goal[s] < 2 * sizes[s] - 1e-9]
        if not open_ones:
            break
        part = left / sum(weight[s] for s in open_ones)
        left = 0.0
        for s in open_ones:
            goal[s] += part * weight[s]
            left += max(0.0, goal[s] - 2 * sizes[s])
            goal[s] = min(goal[s], 2 * sizes[s])
    return goal


def test_mixture_meets_its_targets(documents, rows):
    sizes = defaultdict(int)
    for _, t, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(t or ""))
    goal = brute_targets(sizes)
    found = mixing.mix(documents).collect()
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert len(found) == len(rows)
    for source, words in taken.items():
        assert words == pytest.approx(goal[source], abs=0.03 * goal[source] + 10)
    again = mixing.mix(documents.repartition(2)).collect()
    key = lambda r: (str(r.doc_id), r.text_hash, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_tilts_solve_the_dual(spark):
    rng = random.Random(1)
    counts = [(s, rng.randrange(1, 400), rng.randrange(1, 5)) for s in ("a", "b", None) for _ in range(60)]
    table = spark.createDataFrame(counts, "src string, size long, n long").groupBy("src", "size").agg(F.sum("n").alias("n"))
    sources = table.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    solved = mixing.tilts(table, mixing.targets(sources, mixing.WEIGHTS, 1.5, 2.0), 2.0).collect()
    for r in solved:
        words = sum(n * size * (2.0 if r.tilt is None else min(2.0, math.exp(r.tilt * size / r["mean"]))) for s, size, n in counts if s == r.src)
        assert words == pytest.approx(r.target, rel=1e-6)


def test_copies_are_rows(documents, nothing):
    taken = mixing.mixed_documents(documents)
    assert taken.columns == documents.columns
    assert taken.count() == mixing.mix(documents).agg(F.sum("copies")).first()[0]
    assert mixing.mix(nothing).count() == mixing.mixed_documents(nothing).count() == 0


LANGUAGES = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec mais comme ou si leur".split(),
}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(4, 60))), lang) for i in range(300) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!", "fr"), (1003, "the and of", None), (None, "der die und", "de"), (1004, "the of " * 50_000, "en")]
    return spark.createDataFrame([(*r, "x", 9.0, "y") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3)


def test_languages_are_told_apart(spoken):
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language_id.fit(spoken, fold(F.col("doc_id"), 5) != 0)
    found = language_id.identify(spoken.withColumn("held", held), model).collect()
    assert len(found) == spoken.count() and all(0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (not r.text or not any(map(str.isalpha, r.text))) for r in found)
    tested = [r for r in found if r.held and r.lang_pred != "und"]
    assert len(tested) > 40 and sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all((r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held for r in found)
    kept = language_id.recognised(spoken)
    assert kept.columns == spoken.columns and {r.doc_id for r in spoken.collect()} - {r.doc_id for r in kept.collect()} == {1000, 1001, 1002}


def test_pieces_of_long_texts_count_alike(monkeypatch):
    text = "Die Würde des Menschen ist unantastbar. " * 40
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "_PIECE", 37)
    assert (language_id.gram_counts(text) == whole).all()


def test_no_language_to_learn(nothing, spark):
    model = language_id.fit(nothing, F.lit(True))
    assert language_id.identify(nothing, model).count() == 0
    some = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(some, model).first().lang_pred == "und"


def brute_statistics(text):
    words = WORD.findall(text or "")
    at, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    for places in at.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, rows, nothing):
    rng = random.Random(4)
    phrase = "one two three four five six seven eight nine"
    more = [phrase + " x " + phrase, " ".join(["go"] * 40), "a b\na b\n\n \na b\r\n", "\x0b\x0c||x $5 <b>&amp; #%*", "\n".join(rng.choice("ab") for _ in range(300)), phrase * 3]
    texts = [t for _, t, *_ in rows] + more
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.statistics(table).collect():
        wanted = brute_statistics(texts[r.doc_id])
        assert tuple(r[n] for n in names) == wanted
        assert r.base_failed == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
    assert quality_rules.statistics(nothing).count() == 0


def test_rules_are_learned_in_order(spark):
    rng = random.Random(6)
    speak = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        kind = i % 8
        text = speak(rng.randrange(30, 90))
        text = text.replace(" ", "$ ") if kind == 0 else text.upper() if kind == 1 else text
        rows.append((i, text)), labels.append((i, 0 if kind < 2 else 1))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(3, None), (None, 0)], "doc_id long, quality int")
    stats = quality_rules.statistics(table)
    rules = quality_rules.learn(stats, marks)
    assert {c.attribute for rule in rules for c in rule} >= {"capitals"} and 1 < len(rules) <= 4
    kept = {r.doc_id: r.kept for r in quality_rules.judged(stats, rules).collect()}
    assert sum(kept[i] == (i % 8 > 1) for i in kept) >= 0.99 * len(kept)
    assert quality_rules.learn(stats, marks.filter("quality = 1")) == [] and quality_rules.learn(stats, marks.limit(0)) == []
    assert all("Python" not in line for line in quality_rules.judged(stats, rules)._jdf.queryExecution().toString().splitlines())


def test_toxic_texts_are_found(spark):
    rng = random.Random(8)
    calm = ["river", "stone", "walk", "morning", "paper", "quiet", "blue", "window", "garden", "letter", "you", "the", "of", "and"]
    rude = ["zorgon", "blixt", "vargle"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randrange(10, 60))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "", "s"]))
        rows.append((i, " ".join(words))), labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "zorgon you zorgon")]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, probability string, score double").repartition(2)
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), marks, fold(F.col("doc_id"), 4) != 2)
    found = model.score(table).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found) and found[0].probability == "x"
    held = [(r.score >= 0.3, r.doc_id % 5 == 0) for r in found if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert {r.score >= 0.3 for r in found if r.doc_id is None} == {True} and {r.score >= 0.3 for r in found if r.doc_id in (900, 901)} == {False}
    flat = toxicity.fit(table.select("doc_id", "text"), marks.filter("toxic = 0"), F.lit(True))
    assert {r.score for r in flat.score(table).collect()} == {0.0} and flat.score(table.limit(0)).count() == 0


def test_word_kinds():
    kinds = toxicity.WordKinds(frozenset({"zorgon", "varg~"}))
    hit, hidden = toxicity._HIT, toxicity._HIT | toxicity._HIDDEN
    assert [kinds[w] & hidden for w in ("Zorgon!", "varglest", "z0rg0n", "z-o-r-g-o-n", "river", "varg")] == [hit, hit, hidden, hidden, 0, 0]
    assert kinds["YOU"] & toxicity._SECOND and kinds["YOU"] & toxicity._SHOUT and kinds["a***b"] & toxicity._MASKED
    assert len(toxicity.features("", kinds)) == len(toxicity.FEATURES) == len(toxicity.features("you zorgon", kinds))
