"""Metrics on small hand-made runs."""

import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gleaner.operators import metrics


def frames(spark, run, judged):
    hits = spark.createDataFrame(run, "qid string, docid string, score double")
    qrels = spark.createDataFrame(judged, "qid string, docid string, relevance double")
    return hits, qrels


def test_hand_example(spark):
    run = [("q", d, 10.0 - i) for i, d in enumerate("abcde")] + [("unjudged", "a", 1.0), ("none", "x", 1.0)]
    judged = [("q", "b", 1.0), ("q", "d", 1.0), ("q", "z", 1.0), ("none", "y", 1.0), ("unseen", "a", 1.0)]
    hits, qrels = frames(spark, run, judged)
    rows = {r["qid"]: r for r in metrics.query_metrics(hits, qrels, ks=(3, 5)).collect()}
    assert set(rows) == {"q", "none"}  # in both the run and the judgements
    q = rows["q"]
    ideal = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert q["ndcg@5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert q["map@5"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert q["map@3"] == pytest.approx((1 / 2) / 3)
    assert (q["recall@5"], q["precision@5"], q["mrr@5"]) == pytest.approx((2 / 3, 2 / 5, 1 / 2))
    assert all(rows["none"][f"{m}@5"] == 0 for m in metrics.METRICS)


def test_document_hit_twice_counts_with_its_best_score(spark):
    hits, qrels = frames(spark, [("q", "a", 1.0), ("q", "b", 2.0), ("q", "a", 3.0)], [("q", "a", 1.0)])
    assert metrics.query_metrics(hits, qrels).first()["mrr@10"] == 1.0


def test_last_judgement_wins(spark):
    qrels = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 0.0, 2)], "qid string, docid string, relevance double, place int")
    assert metrics.unique_qrels(qrels, "place").first()["relevance"] == 0.0


def test_ties_rank_by_document_downwards(spark):
    hits, qrels = frames(spark, [("q", "a", 1.0), ("q", "b", 1.0)], [("q", "a", 1.0)])
    assert metrics.query_metrics(hits, qrels).first()["mrr@10"] == 0.5


def test_models_side_by_side(spark):
    hits, qrels = frames(spark, [("q", "a", 2.0), ("q", "b", 1.0)], [("q", "a", 1.0)])
    worse = hits.selectExpr("'worse' as model", "qid", "docid", "-score as score")
    both = hits.selectExpr("'better' as model", "qid", "docid", "score").union(worse)
    rows = {r["model"]: r["ndcg_at_10"] for r in metrics.compare_models(both, qrels).collect()}
    assert rows == {"better": 1.0, "worse": pytest.approx(0.63093)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    run=st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("abcdefgh"), st.integers(0, 5)), min_size=1, max_size=20),
    judged=st.lists(st.tuples(st.sampled_from("pq"), st.sampled_from("abcdefgh"), st.sampled_from([0.0, 0.5, 1.0])), min_size=1, max_size=12),
)
def test_metrics_stay_in_range(spark, run, judged):
    hits, qrels = frames(spark, [(q, d, float(s)) for q, d, s in run], judged)
    for row in metrics.query_metrics(hits, qrels, ks=(2, 5)).collect():
        for m in metrics.METRICS:
            assert 0 <= row[f"{m}@2"] <= 1 + 1e-9 and 0 <= row[f"{m}@5"] <= 1 + 1e-9
        assert row["recall@5"] >= row["recall@2"]


def test_perfect_ranking_has_ndcg_one(spark):
    hits, qrels = frames(spark, [("q", d, 9.0 - i) for i, d in enumerate("abc")], [("q", "a", 1.0), ("q", "b", 0.5)])
    assert metrics.query_metrics(hits, qrels).first()["ndcg@10"] == pytest.approx(1.0)
