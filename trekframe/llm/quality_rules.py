"""Quality rules: learned decision lists over text statistics, from DataFrame functions alone.

``statistics`` counts, for each whole text, words, symbols, repeated lines and words in repeated windows.  ``learn``
finds an ordered list of rules by sequential covering: a rule is a conjunction of threshold conditions, grown on one
part of the labelled rows by information gain, cut back on the other part, accepted if precise there, and its rows are
then set aside.  Every step is one aggregate over all labelled rows, by attribute and threshold bin; only these counts
reach the driver.  ``verdict`` is the list as one conditional expression.

Defined results: null and empty texts have no words and fail the base rule; ids without a label, null labels and null
ids are not learned from; of several labels of an id the smallest counts; without labelled rows of both kinds the list
is empty and keeps what passes the base rule; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, written

WINDOW = 8
MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_ROWS = 8, 3, 0.9, 3
_WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows of so many words that occur twice or more in the array."""

    def covered(places: Column) -> Column:
        """Words under windows that start at the given places (ascending)."""
        steps = F.zip_with(places, F.slice(places, F.lit(2), F.size(places)), lambda a, b: F.coalesce(F.least(F.lit(window), b - a), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def among(ordered: Column) -> Column:
        """ordered: (hash, place) of every window."""
        same = lambda x, i: F.coalesce(F.get(ordered, i)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def found(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), among))

    starts = F.sequence(F.lit(1), F.size(words) - F.lit(window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, found)).cast("long")


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text; see the module's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_WORD))
    left = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    counted = documents.select(
        F.col("doc_id"), of_words.alias("w"), of_lines.alias("l"), left(r"#*$%&|<>").alias("n_symbols"),
        left(r"\p{Lu}").alias("n_upper"), left(r".,;:!?").alias("n_marks"), left("0-9").alias("n_digits"),
    )
    return counted.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks", "n_digits").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1).cast("long"))




def attributes() -> dict[str, Column]:
    """Shares that do not depend on a text's length, and its length."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "word_chars"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "distinct_words": _share("n_distinct", "n_words"),
        "capitals": _share("n_upper", "word_chars"),
        "marks": _share("n_marks", "n_words"),
        "digits": _share("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    """attribute > threshold (above) or attribute <= threshold."""

    attribute: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.attribute] > self.threshold if self.above else of[self.attribute] <= self.threshold

    def __str__(self) -> str:
        return f"{self.attribute} {'>' if self.above else '<='} {self.threshold:.6g}"


def holds(rule: list[Condition], of: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(of)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list: false for the first rule that holds, else true."""
    of = attributes()
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        out = out.when(holds(rule, of), F.lit(False))
    return out.otherwise(F.lit(True))


def _gain(p: int, n: int, all_p: int, all_n: int) -> float:
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n)))


def _counts(rows: DataFrame, names: list[str]) -> dict[str, list[tuple[int, int, int]]]:
    """By attribute: (bin, bad rows, good rows), ascending."""
    bins = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.col(f"bin_{a}").alias("b")) for a in names)))
    sums = rows.select("bad", bins.alias("x")).groupBy("x.a", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    out: dict[str, list] = {a: [] for a in names}
    for row in sums.collect():  # attributes x bins
        out[row["a"]].append((row["b"], row["p"], row["n"]))
    return {a: sorted(found) for a, found in out.items()}


def _best(counts: dict, edges: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition with the largest gain, its bad rows and good rows; of equal thresholds the middle one."""
    tied: list[tuple] = []
    best = 1e-12
    for a, found in sorted(counts.items()):
        all_p, all_n = sum(p for _, p, _ in found), sum(n for _, _, n in found)
        by_bin = {b: (p, n) for b, p, n in found}
        p = n = 0
        for b, edge in enumerate(edges[a]):  # bin b: over edges[b - 1], up to edges[b]
            p, n = p + by_bin.get(b, (0, 0))[0], n + by_bin.get(b, (0, 0))[1]
            for above, x, y in ((False, p, n), (True, all_p - p, all_n - n)):
                gain = _gain(x, y, all_p, all_n)
                if gain > best + 1e-9:
                    best, tied = gain, []
                if gain > best - 1e-9 and (not tied or tied[0][:2] == (a, above)):
                    tied.append((a, above, edge, x, y))
    if not tied:
        return None, 0, 0
    a, above, edge, p, n = tied[len(tied) // 2]
    return Condition(a, above, edge), p, n


def _with_middles(edges: list[float]) -> list[float]:
    """Thresholds between quantiles too, so that one may lie in the gap that parts good from bad."""
    return sorted({*edges, *(x + (y - x) * i / 4 for x, y in zip(edges, edges[1:]) for i in (1, 2, 3))})


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Ordered rules for bad texts from labels (doc_id, quality: 1 good, 0 bad) of texts that pass the base rule."""
    named = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    of = attributes()
    labelled = stats.filter("not base_failed").join(named, "doc_id")
    part = F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(3)) == 0
    rows = written(
        labelled.select(F.when(F.col("quality") == 0, 1).otherwise(0).cast("long").alias("bad"), part.alias("prunes"), *(c.alias(a) for a, c in of.items())),
        "rule-rows",
    )
    names = list(of)
    places = [i / 24 for i in range(1, 24)]
    first = rows.agg(
        *(F.percentile_approx(F.col(a), places, 10_000).alias(f"all_{a}") for a in names),
        *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(a)), places, 10_000).alias(f"bad_{a}") for a in names),
    ).first()
    edges = {a: _with_middles(sorted({*(first[f"all_{a}"] or []), *(first[f"bad_{a}"] or [])})) for a in names}
    over = lambda a: F.size(F.filter(F.array(*map(F.lit, edges[a])), lambda t: F.col(a) > t)) if edges[a] else F.lit(0)
    rows = written(rows.withColumns({f"bin_{a}": over(a) for a in names}), "rule-bins")
    by_name = {a: F.col(a) for a in names}
    left, rules = F.lit(True), []
    while len(rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            inside = rows.filter(left & ~F.col("prunes") & holds(rule, by_name))
            condition, p, n = _best(_counts(inside, names), edges)
            if condition is None or p < LEAST_ROWS:
                break
            rule.append(condition)
            if not n:
                break
        if not rule:
            break
        sums = []
        for k in range(1, len(rule) + 1):
            inside = holds(rule[:k], by_name)
            sums += [F.sum(F.when(inside, F.col("bad"))).alias(f"p{k}"), F.sum(F.when(inside, 1 - F.col("bad"))).alias(f"n{k}")]
        row = rows.filter(left & F.col("prunes")).agg(*sums).first()
        found = [(row[f"p{k}"] or 0, row[f"n{k}"] or 0, k) for k in range(1, len(rule) + 1)]
        p, n, k = max(found, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0], -x[2]))
        if p < LEAST_ROWS or p < LEAST_PRECISION * (p + n):
            break
        rules.append(rule[:k])
        left = left & ~holds(rule[:k], by_name)
    return rules


def judged(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with kept."""
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and verdict of every document."""
    stats = written(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "text-statistics")
    rules = learn(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
