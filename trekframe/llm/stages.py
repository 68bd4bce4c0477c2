"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of docs.

Defined results: language ID drops null and empty texts and those without letters, so later stages get none from it; on
their own, exact dedup keeps one of the empty texts, the near-duplicate stage and the mix drop nothing for being empty but
the mix takes documents without words no times, and packing gives an empty text its end id.  Rows with a null doc_id are
kept unless their text is dropped; rows that repeat id and text are one group (exact dedup leaves one).  Texts of any length
are read whole; an empty table gives an empty result with the same columns; other columns, whatever their names, go through
all stages but the last, which returns the columns of its pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import deduplicate
from .language_id import recognised
from .mixing import mixed_documents
from .ngram_join import one_of_each
from .packing import TOKENIZER, pack


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to target weights", mixture),
    ("best-fit packing", packed),
]
