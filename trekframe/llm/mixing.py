"""Mixing sources to target weights by entropy balancing.

Of all document rates the nearest to the corpus as it is (in relative entropy, every rate at most 2) are sought under
which each source has its target number of words.  Their dual is convex and falls apart by source: the rate of a
document is ``exp(tilt * size / mean size)``, at most 2, and the tilt solves one equation.  Newton steps, kept inside a
bracket, run for all sources at once; each is one distributed aggregate over the counts of documents by source and
size.  Rates are then rounded into copies cell by cell (a cell is a bounded, hashed part of a source, so a source may
hold any share of the rows): from the longest document down, each gets the floor of its rate or one more, whichever
keeps the cell's running number of words nearest to what the rates ask for.  Repeated rows are one row with their number
until then, and share the copies that they get together, so a row repeated any number of times fills no task.

Defined results: null texts and texts without words have size 0 and take nothing; a null source is a source of its own,
last in order; repeated rows are mixed on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import class_rank, drop, text_hash, word_count, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a cell in which rates are rounded, about.
CELL_ROWS = 8192
TOLERANCE, MOST_STEPS = 1e-10, 80


def targets(sources: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """sources (src, source_size, n; one row a source) with target.

    Weights go round by code-point order of the sources, null last.  The total is shared by weight; what exceeds
    ``most`` times a source's size is shared again until none does, so a target is the smaller of that bound and a
    common level times the weight.  Only sums come to the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    turn = F.pmod(place, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    named = written(sources.withColumn("weight", weight).withColumn("bound", most * F.col("source_size")), "mix-sources")
    total = total_share * (named.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("bound") <= level * F.col("weight")
        row = named.agg(
            F.sum(F.when(full, F.col("bound"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        higher = (total - (row["full"] or 0.0)) / row["open"]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return named.withColumn("target", F.least("bound", level * F.col("weight"))).drop("weight")


def _rate(most: float) -> Column:
    """The rate of a document of a size under its source's tilt."""
    z = F.col("tilt") * F.col("size") / F.col("mean")
    return F.when(F.col("tilt").isNull(), F.lit(most)).when(z >= math.log(most), F.lit(most)).otherwise(F.exp(z))


def tilts(counts: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """goals with mean and tilt (null: every rate is the bound); counts: (src, size, n)."""
    start = goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9)))
    start = start.withColumn("tilt", F.when(F.col("target") < F.col("bound") * (1 - 1e-12), F.lit(0.0)))
    state = start.select("*", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    state = written(state.withColumn("done", F.col("tilt").isNull()), "mix-tilts")
    hist = counts.filter("size > 0").withColumnRenamed("n", "docs")
    for _ in range(MOST_STEPS):
        open_ones = state.filter("not done")
        words = F.col("docs") * F.col("size") * _rate(most)
        inside = F.col("tilt") * F.col("size") / F.col("mean") < math.log(most)
        sums = (
            hist.join(open_ones.select(F.col("src").alias("s"), "tilt", "mean"), F.col("src").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(words).alias("words"), F.sum(F.when(inside, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        fits = (F.col("slope") > 0) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        between = (
            F.when(low.isNull(), high - F.greatest(F.lit(1.0), F.abs(high)))
            .when(high.isNull(), low + F.greatest(F.lit(1.0), F.abs(low)))
            .otherwise((low + high) / 2)
        )
        good = F.abs(gap) <= TOLERANCE * F.col("target")
        after = state.join(sums, F.col("src").eqNullSafe(F.col("s")), "left").withColumn("open", ~F.col("done") & F.col("words").isNotNull())
        keep = lambda new, old: F.when(F.col("open"), new).otherwise(F.col(old))
        state = written(
            after.select(
                "src", "source_size", "n", "bound", "target", "mean",
                keep(F.when(good, F.col("tilt")).when(fits, newton).otherwise(between), "tilt").alias("tilt"),
                keep(low, "low").alias("low"), keep(high, "high").alias("high"),
                (~F.col("open") | good).alias("done"),
            ),
            "mix-tilts",
        )
        if state.filter("not done").isEmpty():
            break
    # Sums of doubles depend on their order in the last digits; rounding makes reruns agree.
    return state.select("src", "source_size", "n", "target", "mean", F.round("tilt", 9).alias("tilt"))


def round_rates(sizes: list[int], rates: list[float], times: list[int], most: float) -> list[int]:
    """Copies of documents (longest first, each there so many times) that keep the running number of words nearest to
    what the rates ask for."""
    copies, owed = [], 0.0
    for size, rate, n in zip(sizes, rates, times, strict=True):
        least = math.floor(rate)
        owed += n * (rate - least) * size
        more = min(n, max(0, math.ceil(owed / size - 0.5))) if size and rate > least else 0
        copies.append(n * least + more)
        owed -= size * more
    # What long documents leave that the others' rates could not take up: copies more or less where they fit.
    for i, (size, n) in enumerate(zip(sizes, times, strict=True)):
        if 0 < size <= owed:
            more = min(int(owed // size), math.floor(most * n) - copies[i])
        elif 0 < size <= -owed:
            more = -min(int(-owed // size), copies[i])
        else:
            more = 0
        copies[i], owed = copies[i] + more, owed - size * more
    return copies


def _rounder(most: float):
    def rounded(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable")
        copies = round_rates(*(cell[k].tolist() for k in ("size", "rate", "times")), most)
        return cell.assign(copies=copies)[["doc_id", "text_hash", "src", "size", "times", "copies"]]

    return rounded


def _own_copies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (a written table) that repeat each other, of which copies and times are those of all of them: each row's own
    copies instead.  columns tell the groups apart, row a group's rows."""
    group = F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))
    ranked = class_rank(rows.withColumn("group", group), ["group"], ["row"])
    share = F.floor(F.col("copies") / F.col("times")) + (F.col("rank") < F.pmod(F.col("copies"), F.col("times"))).cast("long")
    return ranked.withColumn("copies", share.cast("long")).drop("group", "rank", "row", "times")


def grouped_mix(documents: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: doc_id, text_hash, src, size, row of every row; the groups of rows that agree in the first four,
    with times (rows) and copies (of all of them together); src, source_size and target of every source."""
    light = written(
        documents.select(
            F.col("doc_id").cast("long"), text_hash().alias("text_hash"), F.col("source").cast("string").alias("src"),
            word_count(F.col("text").cast("string")).alias("size"), F.monotonically_increasing_id().alias("row"),
        ),
        "mix-sizes",
    )
    counts = written(light.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    solved = tilts(counts, targets(sources, weights, total_share, most), most)
    cells = F.ceil(F.col("n") / CELL_ROWS)
    groups = light.groupBy("doc_id", "text_hash", "src", "size").agg(F.count(F.lit(1)).alias("times"))
    rated = groups.join(solved.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).select(
        "doc_id", "text_hash", "src", "size", "times", _rate(most).alias("rate"), F.pmod(F.xxhash64("doc_id", "text_hash"), cells).alias("cell")
    )
    schema = "doc_id long, text_hash long, src string, size long, times long, copies long"
    rounded = written(rated.groupBy("src", "cell").applyInPandas(_rounder(most), schema), "mix-copies")
    drop(counts)
    return light, rounded, solved.select("src", "source_size", "target")


def mix(
    documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target and copies for every row of documents."""
    light, groups, goals = grouped_mix(documents, weights, total_share, most)
    columns = ["doc_id", "text_hash", "src", "size"]
    rounded = groups.filter("times = 1").select(*columns, "copies")
    several = groups.filter("times > 1")
    if not several.isEmpty():
        there = several.toDF(*(f"_{c}" for c in columns), "times", "copies")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
        repeated = written(light.join(there, same).select(*columns, "row", "times", "copies"), "mix-repeated")
        rounded = rounded.unionByName(_own_copies(repeated, columns))
    named = goals.withColumnRenamed("src", "s")
    return rounded.join(named, F.col("src").eqNullSafe(F.col("s"))).select(
        "doc_id", "text_hash", F.col("src").alias("source"), "size", "source_size", "target", "copies"
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """documents with every row as often as the mix takes it; all columns."""
    light, groups, _ = grouped_mix(documents, WEIGHTS, 1.5, 2.0)
    drop(light)
    columns = ["doc_id", "text_hash", "src"]
    whole = documents.select(
        F.struct(*documents.columns).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"),
        F.col("source").cast("string").alias("src"),
    )

    def joined(wanted: DataFrame) -> DataFrame:
        there = wanted.filter("copies > 0").select(*(F.col(c).alias(f"_{c}") for c in columns), "times", "copies")
        return whole.join(there, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]).select("doc", *columns, "times", "copies")

    taken = joined(groups.filter("times = 1")).select("doc", "copies")
    several = groups.filter("times > 1")
    if not several.isEmpty():
        repeated = written(joined(several).withColumn("row", F.monotonically_increasing_id()), "mix-repeated")
        taken = taken.union(_own_copies(repeated, columns).select("doc", "copies"))
    each = taken.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select("doc.*")


def op8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets alone, as SQL can state them: of every document of the mix."""
    return op8_entropy_balance(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


TARGETS_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
filling AS (
  SELECT *, 2 * source_size / weight AS full_at,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 2 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
found AS (SELECT min_by(level, full_at) AS level FROM filling WHERE level <= full_at)
SELECT doc_id, size, source_size, round(least(2 * source_size, coalesce((SELECT level FROM found), 1e300) * weight), 4) AS target
FROM d JOIN sources ON d.source IS NOT DISTINCT FROM sources.source
"""


def op8_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
