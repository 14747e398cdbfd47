"""Training-corpus pipeline: from documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes in the shared folder and
reads again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import Scratch
from gleaner.llm.mixing import mixed_documents
from gleaner.llm.packing import pack_documents
from gleaner.llm.paragraph_dedup import remove_repeated_paragraphs
from gleaner.llm.quality_classifier import keep_good
from gleaner.llm.simhash import drop_near_copies

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; labels are the labels table's."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose SimHash fingerprints of three-word shingles lie within two bits."""
    return drop_near_copies(docs, radius=2, width=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that stand elsewhere too are cut out; a document without any word left goes."""
    return remove_repeated_paragraphs(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none over twice."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 ids."""
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: No SQL: classifier training, fingerprint components and packing can't be said in it; tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the packed pieces."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
