"""Registered queries of the training-data operators, each over the whole documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.exact_search import search_embeddings
from gleaner.llm.fingerprints import document_fingerprints
from gleaner.llm.lexical_search import ranked_search
from gleaner.llm.mixing import mix_sources
from gleaner.llm.oracles import ORACLES  # noqa: F401
from gleaner.llm.packing import pack_documents
from gleaner.llm.paragraph_dedup import paragraph_removals
from gleaner.llm.quality_classifier import quality_scores
from gleaner.llm.quality_rules import quality_rules
from gleaner.llm.simhash import simhash_groups
from gleaner.llm.spelling import planted_slip, spelling_variants
from gleaner.llm.suffix_dedup import remove_repeats
from gleaner.llm.token_counts import token_counts
from gleaner.llm.training_order import write_training_order
from gleaner.session import new_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_training_order(documents(spark, sf_dir), new_path(spark, "shards"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).drop("group", "text_hash")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_removals(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels).drop("text_hash")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("text_hash")


def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir), respell=planted_slip)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_training_order,
        op2_simhash,
        op3_packing,
        op4_paragraphs,
        op5_quality_classifier,
        op6_fingerprints,
        op7_quality_rules,
        op8_token_counts,
        op9_suffix_dedup,
        op10_mixing,
        op11_exact_search,
        op12_spelling,
        op13_ranked_search,
    )
}
# The other operators hash, train or pack in ways that SQL can't express; tests hold them against brute force.
