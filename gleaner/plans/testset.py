"""Class-labelled texts to a retrieval test set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.functions.draws import draw
from gleaner.functions.text import first_label, only_family
from gleaner.operators.labels import collect_by_class, lookup_required
from gleaner.operators.ordering import dense_ids
from gleaner.operators.sampling import sample_k_per_class


def build_test_set(
    decisions: DataFrame,
    laws: DataFrame,
    prefix: str,
    k: int = 10,
    seed: int = 613,
    key: str = "key",
    labels: str = "laws_service",
    text: str = "fact",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels): k drawn texts of every class with at least k, one query per class.

    Rows with a label outside the family are left out, the first label of the others is their class.
    Corpus ids count from 0 in class order; the query of a class is the law of that title.
    """
    kept = decisions.where(only_family(labels, prefix))
    single = kept.select(key, F.col(text).alias("text"), first_label(labels).alias("label"))
    classed = collect_by_class(single, "label", k, [key])
    drawn = sample_k_per_class(classed, "label", key, k, seed)
    numbered = dense_ids(drawn, ["label", draw(seed, F.lit("corpus"), key), key], id_col="_doc")
    found = lookup_required(numbered.select("label").distinct(), laws)
    query = found.select("label", F.col("id").cast("string").alias("qid"), "text")
    doc = F.col("_doc").cast("string")
    queries = query.select(F.col("qid").alias("id"), "text")
    corpus = numbered.select(doc.alias("id"), F.array("text").alias("text"))
    qrels = numbered.select("label", doc.alias("docid")).join(query.select("label", "qid"), "label")
    return queries, corpus, qrels.select("qid", "docid", F.lit(1).alias("relevance"))
