"""Search with an encoder's vectors and judge the result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.embedding import Batches, Encoder, encode, instructed
from gleaner.operators.knn import knn_topk
from gleaner.operators.metrics import KS, compare_models
from gleaner.operators.records import flatten_corpus

DEPTH = 100
MakeEncoder = Callable[[], Encoder] | None


@dataclass(frozen=True)
class Model:
    """How a model encodes: passages by make_encoder, queries by make_query_encoder or else the same, each with
    its own instruction before the text and its own maximum length in words. batches bounds what an encoder gets
    at once."""

    make_encoder: MakeEncoder = None
    make_query_encoder: MakeEncoder = None
    query_instruction: str | None = None
    query_format: str = "{}{}"
    passage_instruction: str | None = None
    passage_format: str = "{}{}"
    query_max_length: int | None = None
    passage_max_length: int | None = None
    batches: Batches = Batches()


def search(
    queries: DataFrame, corpus: DataFrame, model: Model | MakeEncoder = None, k: int = DEPTH, dim: int = 64
) -> DataFrame:
    """(qid, docid, score): the k best documents of each query; a document scores as its best passage."""
    model = model if isinstance(model, Model) else Model(model)
    asked = instructed("text", model.query_instruction, model.query_format)
    told = instructed("text", model.passage_instruction, model.passage_format)
    q_vec = encode(asked, model.make_query_encoder or model.make_encoder, dim, model.query_max_length, model.batches).alias("q_vec")
    q = queries.select(F.col("id").alias("q_id"), q_vec)
    passages = flatten_corpus(corpus)
    c_vec = encode(told, model.make_encoder, dim, model.passage_max_length, model.batches).alias("c_vec")
    c = passages.select(F.col("id").alias("c_id"), c_vec)
    hits = knn_topk(q, c, k, unique_ids=False)
    return hits.select(F.col("q_id").alias("qid"), F.col("c_id").alias("docid"), "score")


def evaluate(
    encoders: dict[str, Model | MakeEncoder],
    queries: DataFrame, corpus: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS, dim: int = 64,
) -> DataFrame:
    """One row of metrics per model."""
    runs = [search(queries, corpus, m, dim=dim).withColumn("model", F.lit(name)) for name, m in encoders.items()]
    # A search gives each document of a query once.
    return compare_models(reduce(DataFrame.unionByName, runs), qrels, ks, unique=True)
