"""Retrieval metrics over ranked hits and judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


METRICS = ("ndcg", "map", "recall", "precision", "mrr")
KS = (10, 50)


def unique_qrels(qrels: DataFrame, order: str | None = None) -> DataFrame:
    """One judgement per (qid, docid): the last by the order column, else the highest."""
    relevance = F.max_by("relevance", order) if order else F.max("relevance")
    return qrels.groupBy("qid", "docid").agg(relevance.cast("double").alias("relevance"))


def best_hits(hits: DataFrame, by: str | None = None) -> DataFrame:
    """One hit per document: the one with the best score."""
    keys = ([by] if by else []) + ["qid", "docid"]
    return hits.groupBy(*keys).agg(F.max("score").alias("score"))


def _judge(hits: DataFrame, judged: DataFrame) -> DataFrame:
    joined = hits.join(judged, ["qid", "docid"], "left")
    return joined.withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def join_qrels(
    hits: DataFrame, qrels: DataFrame, order: str | None = None, by: str | None = None
) -> DataFrame:
    """Hits with their relevance, 0 where not judged. A document hit twice counts with its best score."""
    return _judge(best_hits(hits, by), unique_qrels(qrels, order))


def _gain(relevance: Column, rank: Column) -> Column:
    return relevance / F.log2(rank + 1)


def _ideal(judged: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Per query: number of relevant documents, and the ideal DCG over all judged documents."""
    relevant = judged.groupBy("qid").agg(F.sum((F.col("relevance") > 0).cast("int")).alias("_relevant"))
    order = Window.partitionBy("qid").orderBy(F.desc("relevance"), "docid")
    ranked = judged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(ks))
    gain = _gain(F.col("relevance"), F.col("_r"))
    ideal = ranked.groupBy("qid").agg(
        *[F.sum(F.when(F.col("_r") <= k, gain).otherwise(0.0)).alias(f"_ideal{k}") for k in ks]
    )
    return relevant.join(ideal, "qid")


def query_metrics(
    hits: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = KS,
    by: str | None = None,
    order: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Every metric at every k, one row per query (and model): columns ndcg@10, map@10, ...

    Queries must be in both the hits and the judgements. Hits are ranked and cut to the best max(ks) of a
    query before they meet the judgements. unique says that no document is hit twice for a query (and
    model), which saves the step that sees to it.
    """
    group = ([by] if by else []) + ["qid"]
    judged = unique_qrels(qrels, order)
    window = Window.partitionBy(*group)
    by_score = window.orderBy(F.desc("score"), F.desc("docid"))
    best = hits.select(*group, "docid", "score") if unique else best_hits(hits, by)
    best = best.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= max(ks))
    ranked = _judge(best, judged)
    found = (F.col("relevance") > 0).cast("int")
    running = F.sum(found).over(window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_found", found).withColumn("_precision", running / F.col("_r"))

    aggs = [F.min(F.when(F.col("_found") == 1, F.col("_r"))).alias("_first")]
    for k in ks:
        top = F.col("_r") <= k
        aggs += [
            F.sum(F.when(top, _gain(F.col("relevance"), F.col("_r"))).otherwise(0.0)).alias(f"_dcg{k}"),
            F.sum(F.when(top, F.col("_found")).otherwise(0)).alias(f"_hits{k}"),
            F.sum(F.when(top & (F.col("_found") == 1), F.col("_precision")).otherwise(0.0)).alias(f"_ap{k}"),
        ]
    per_query = ranked.groupBy(*group).agg(*aggs).join(_ideal(judged, ks), "qid")

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    out = []
    for k in ks:
        first = F.col("_first")
        out += [
            ratio(F.col(f"_dcg{k}"), F.col(f"_ideal{k}")).alias(f"ndcg@{k}"),
            ratio(F.col(f"_ap{k}"), F.col("_relevant")).alias(f"map@{k}"),
            ratio(F.col(f"_hits{k}"), F.col("_relevant")).alias(f"recall@{k}"),
            (F.col(f"_hits{k}") / F.lit(float(k))).alias(f"precision@{k}"),
            F.when(first <= k, 1.0 / first).otherwise(0.0).alias(f"mrr@{k}"),
        ]
    return per_query.select(*group, *out)


def compare_models(
    hits: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = KS,
    by: str | None = "model",
    metrics: Sequence[str] = METRICS,
    order: str | None = None,
    digits: int = 5,
    unique: bool = False,
) -> DataFrame:
    """Mean of every metric over the queries, one row per model, in one pass over all models."""
    means = [
        F.round(F.avg(f"`{m}@{k}`"), digits).alias(f"{m}_at_{k}") for m in metrics for k in ks
    ]
    return query_metrics(hits, qrels, ks, by, order, unique).groupBy(*([by] if by else [])).agg(*means)


def metric_ndcg(hits, qrels, ks=KS, by=None) -> DataFrame:
    return compare_models(hits, qrels, ks, by, ["ndcg"])


def metric_map(hits, qrels, ks=KS, by=None) -> DataFrame:
    return compare_models(hits, qrels, ks, by, ["map"])


def metric_recall(hits, qrels, ks=KS, by=None) -> DataFrame:
    return compare_models(hits, qrels, ks, by, ["recall"])


def metric_precision(hits, qrels, ks=KS, by=None) -> DataFrame:
    return compare_models(hits, qrels, ks, by, ["precision"])


def metric_mrr(hits, qrels, ks=KS, by=None) -> DataFrame:
    return compare_models(hits, qrels, ks, by, ["mrr"])


def qrels_map(qrels: DataFrame, order: str | None = None, parts: int = 1) -> DataFrame:
    """(qid, part, judgements): docid -> relevance maps of every query.

    Documents are dealt over `parts` maps by their hash, for all queries alike: take more where a query may
    have more judgements than a row should hold. A part that got none has no row.
    """
    judged = unique_qrels(qrels, order)
    entries = judged.withColumn("part", F.pmod(F.xxhash64("docid"), F.lit(parts)).cast("int"))
    as_map = F.map_from_entries(F.collect_list(F.struct("docid", "relevance")))
    return entries.groupBy("qid", "part").agg(as_map.alias("judgements"))
