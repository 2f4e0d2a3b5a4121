"""Corpus pipeline: five stages over the documents table, each an operator of episodeflow.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. language   drops documents whose language cannot be identified (operator 9)
2. quality    drops documents predicted to be of label 0 (operator 1)
3. near_dedup keeps one document of each near-duplicate component (operator 3)
4. mix        selects each source's share of the token budget, one epoch at most (operator 5)
5. pack       packs the rest into token windows, retrieved neighbours together (operator 8)

Ids may be null or repeated. Language and quality judge each row by its id and text, so rows equal in
both share their verdict and a null id loses nothing. near_dedup keeps one row of those that are equal in
id and text, whichever comes; a row without an id is in no component and stays, but once. A repeated id
with different texts is one document to it: all such rows stay if one of them does.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeflow.llm import budget_mix, language_id, near_dedup, quality_gam, retrieval_packing
from episodeflow.llm.common import land, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: In a corpus no document is repeated: one epoch.
MIX = replace(budget_mix.PRODUCTION, epochs=1)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, the same for rows that are equal in id and text only (128 bits)."""
    return docs.withColumn("_key", F.concat(F.hex(F.xxhash64("doc_id", "text")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "doc_id", "text"))))


def accepted(docs: DataFrame, verdicts: DataFrame, condition: str) -> DataFrame:
    """Rows of keyed ``docs`` whose verdict (by ``_key``) fulfils the condition."""
    return docs.join(verdicts.filter(condition).select("_key").distinct(), "_key", "left_semi").select(*COLUMNS)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of those that are equal in id and text; only repeated rows are shuffled."""
    rows = keyed(docs)
    repeated = land(rows.groupBy("_key").count().filter("count > 1").select("_key"), "repeated-rows")
    return rows.join(repeated, "_key", "left_anti").unionByName(rows.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return accepted(rows, language_id.identify(language_id.document_rows(rows, "_key")).withColumnRenamed("id", "_key"), "accepted")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    return accepted(rows, quality_gam.score(rows, quality_gam.train(docs, table(spark, sf_dir, "labels")), "_key"), "predicted = 1")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return one_of_each(docs).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return budget_mix.mixed(docs, MIX).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", dedup), ("mix", mix), ("pack", pack)]

#: Language, quality and packing are learned or sequential; SQL cannot express them. Tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is landed in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
