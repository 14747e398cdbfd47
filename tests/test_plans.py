"""The plans are the ones wanted."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from gleaner import catalog
from gleaner.catalog.registry import table
from gleaner.functions import text as tx
from gleaner.operators import ordering, sampling
from gleaner.operators.knn import knn_topk

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def above(text: str, upper: str, lower: str) -> bool:
    return upper in text and lower in text and text.index(upper) < text.index(lower)


def test_top_k_is_cut_below_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    text = plan(sampling.sample_per_group(df, "g", "id", 10))
    assert above(text, "Exchange hashpartitioning(g", "Partial")
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<float>")
    q, c = v.selectExpr("id q_id", "v q_vec"), v.selectExpr("id c_id", "v c_vec")
    text = plan(knn_topk(q, c, 5, blocks=(1, 3)))
    assert above(text, "Exchange hashpartitioning(q_id", "Partial")
    assert "Window" not in plan(knn_topk(q, c, 5, blocks=(3, 1)))  # one cell holds the corpus: nothing to merge
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(table(spark, SF_DIR, "documents").select("doc_id", tx.first_label("lang")))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_filters_reach_the_scan(spark):
    text = plan(table(spark, SF_DIR, "events").where("event_type <> 'error'").select("event_id"))
    assert "Not(EqualTo(event_type,error))" in text


def test_dense_ids_window_holds_partition_sizes_only(spark):
    text = plan(ordering.dense_ids(spark.range(100), "id"))
    single = text[text.index("Window"):]
    assert "partial_count" in single  # what the window orders are counts per partition
    assert text.count("Exchange SinglePartition") <= 1


PYTHON = {
    "mine_with_instructions", "evaluate_two_encoders", "score_dense", "contrastive_loss", "pool_cls", "pool_last", "pool_mean", "in_batch_losses",
    "embed_texts", "knn_topk", "knn_best_passage", "rank_range", "mine_hard_negatives", "join_qrels", "compare_models",
    "knn_pruned", "embed_first_words", "map_batches", "max_token_len_subwords", "score_lexical",
    "score_maxsim", "score_ensemble", "blend_losses", "category_vectors", "self_attention_vectors", "score_attention", "in_batch_loss", "evaluate_test_set",
    *(f"metric_{m}" for m in ("ndcg", "map", "recall", "precision", "mrr")),
}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - PYTHON))
def test_other_queries_run_in_the_jvm_without_cross_joins(spark, name):
    text = plan(spark_entry.queries()[name](spark, SF_DIR))
    assert "Python" not in text and "InArrow" not in text and "ArrowEval" not in text
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["pool_cls", "pool_last", "pool_mean"])
def test_pooling_sorts_no_vectors_in_aggregates(spark, name):
    assert "SortAggregate" not in plan(spark_entry.queries()[name](spark, SF_DIR))


def test_cell_numbers_are_long(spark):
    """60,000 blocks on either side are 3.6 billion cells."""
    from gleaner.operators.knn import block_counts

    left = spark.range(1).select(F.lit(59_999).alias("_lb"))
    cell = left.select((F.col("_lb").cast("long") * 60_000 + F.lit(59_999)).alias("c")).first()["c"]
    assert cell == 60_000 * 60_000 - 1
    small = block_counts(10**6, 10**9, 100, 1024, 1000)
    large = block_counts(10**6, 10**9, 100, 1024, 1000, block_bytes=1 << 30)
    moved = [1024 * (10**6 * c + 10**9 * q) for q, c in (small, large)]
    assert moved[1] < moved[0] / 8  # copies fall with the block size


def test_words_meet_in_the_partition_of_their_document(spark):
    """The texts are shuffled, not their words, which take several times the room."""
    text = plan(spark_entry.queries()["lexical_weights"](spark, SF_DIR))
    assert text.count("Exchange") == 1 and above(text, "Generate", "Exchange hashpartitioning(doc_id")
