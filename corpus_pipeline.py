"""A corpus pipeline: quality classifier, exact deduplication, near-deduplication, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept, written as Parquet
and read again. All stages but the last return the columns of the documents they get; columns that a stage does not read pass, whatever
their names, clashing ones too. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from verdictmill.llm import exact_dedup, kneser_ney, mixing, near_dedup, packing
from verdictmill.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most the threshold of their language, and whose compressed share at least that of trusted text; rejected ones go.

    A null, empty or white text goes; a null language is one of its own; each row is judged by its own text, so repeated rows share their fate, and rows that
    repeat an id need not. A perplexity equal to the threshold stays.
    """
    return kneser_ney.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, a null id last.

    Null and empty texts are equal; rows that repeat an id with different texts are told apart; of rows that repeat both, one stays.
    """
    return exact_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    A null, empty or white text is linked with nothing and stays; rows are told apart by id and text, and those that repeat both share their fate.
    """
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights, a row per copy: a text as often, and as far, as the mix takes it; what it does not take goes.

    A null or empty text is never taken; null sources form one source; repeated rows are documents of their own, and ties in the seeded order go by id, source
    and text.
    """
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each; pieces of equal length go by id and place.
    """
    return packing.best_fit_packing(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing to target weights", mixed), ("best-fit packing", packed)]

#: SQL can express neither the model nor the near copies nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what the last one returns."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    *first, (_, last) = STAGES
    kept = functools.reduce(lambda df, stage: scratch.keep(stage[1](spark, df, sf_dir)), first, docs)
    return last(spark, kept, sf_dir)
