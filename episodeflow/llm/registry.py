"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodeflow.llm import (
    bit_sliced_topk, budget_mix, collision_ann, decontaminate, language_id, near_dedup, phrase_mining, quality_gam, rendezvous_shards, retrieval_packing,
    token_alignment, token_counts, wrapper_extract,
)
from episodeflow.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.select(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_topk.top_products(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous_shards.shards(table(spark, sf_dir, "documents"), [1.0] * rendezvous_shards.N_SHARDS, 1.0)


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.packed(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id set) and pages (page_id set) share one model and one set of host priors."""
    docs = language_id.document_rows(table(spark, sf_dir, "documents"))
    pages = language_id.page_rows(table(spark, sf_dir, "pages"))
    rows = (docs.withColumns({"doc_id": F.col("id"), "page_id": F.lit(None).cast("long"), "id": F.concat(F.lit("d"), F.col("id").cast("string"))})
            .unionByName(pages.withColumns({"doc_id": F.lit(None).cast("long"), "page_id": F.col("id"), "id": F.concat(F.lit("p"), F.col("id").cast("string"))})))
    return language_id.identify(rows).drop("id")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.main_text(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_nearest_neighbours, op3_near_dedup, op4_token_counts, op5_budget_mix, op6_exact_topk, op7_sharding,
        op8_retrieval_packing, op9_language_id, op10_html_extraction, op11_token_alignment, op12_decontamination, op13_collocations)}

SQL: dict[str, str] = {"op5_budget_mix": budget_mix.sql(), "op6_exact_topk": bit_sliced_topk.SQL, "op7_sharding": rendezvous_shards.SQL,
                       "op12_decontamination": decontaminate.SQL, "op13_collocations": phrase_mining.SQL}
