import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, rank int"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "vo") for c in ("n", "st", "")]
    speak = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [speak(rng.randrange(1, 90)) for _ in range(60)]
    base = speak(200)
    for i in range(25):  # near copies, in chains
        parts = base.split()
        for _ in range(i % 4):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + "\n", "", " \t ", None, None, "Ä ß 日本", "one two", "One  TWO", speak(6000)]
    common = speak(30)
    texts += [f"{speak(40)} {common} {speak(40)}" for _ in range(30)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""), 0.5, "x", 1) for i, t in enumerate(texts)]
    out.append(out[3])  # a row twice
    out.append((None, texts[4], "en", "a", 3, 0.5, "x", 1))
    out.append((7, texts[8], "en", "b", 3, 0.5, "x", 1))  # an id with a second text
    return out


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
