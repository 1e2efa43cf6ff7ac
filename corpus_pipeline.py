"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of `documents`; the last
returns a row per document of the written token files. Null and empty texts are rejected by the first stage, as they have
no letter; empty tables pass through every stage. The mix repeats documents, so doc_id may repeat in the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkguard.llm import decontaminate, jaccard, language, mixing, queries, tokens
from linkguard.llm.common import stage, table

#: The model of the first stage and the sampling of the fourth have no SQL counterpart.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID rejects: without a letter, or far from every known language."""
    return language.keep_known(docs, language.fit(docs.where(~language.held_out(F.col("doc_id")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and report each document's place in them, as read back."""
    return tokens.digest(docs, queries.vocabulary())


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mix_sources", mix_sources), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
