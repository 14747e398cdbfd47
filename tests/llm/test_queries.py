"""The registered queries: names, and those that have SQL against it."""

import check
import pytest

import __spark_entry__ as spark_entry
from gleaner.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    names = [n for n in spark_entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in spark_entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert check.compare(name, spark, check.oracle(SF_DIR), SF_DIR) == ""


@pytest.mark.parametrize("name", ["op6_fingerprints", "op10_mixing"])
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


CLASHING = """id some row pair par fp band text_hash size taken place target component_id part sequence_id cell key anchor t1 length q1
 group word n query vec score item rank slot shard record quality label kept n_removed _id _own _hash _n root""".split()


@pytest.fixture(scope="module")
def plain_and_clashing(spark):
    """The first documents, and the same with columns named like results or inner columns."""
    from pyspark.sql import functions as F

    docs = queries.documents(spark, SF_DIR).limit(40)
    return docs, docs.withColumns({n: F.lit(7) for n in CLASHING})


def test_extra_columns_that_clash_change_nothing(spark, plain_and_clashing):
    from gleaner.llm import (
        fingerprints, lexical_search, mixing, packing, paragraph_dedup, quality_classifier, quality_rules, simhash, spelling,
        suffix_dedup, token_counts, training_order,
    )
    from gleaner.session import new_path

    labels, items = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    for operator in (
        simhash.simhash_groups, packing.pack_documents, fingerprints.document_fingerprints, quality_rules.quality_rules,
        token_counts.token_counts, suffix_dedup.remove_repeats, mixing.mix_sources, paragraph_dedup.paragraph_removals,
        lambda df: quality_classifier.quality_scores(df, labels), lambda df: spelling.spelling_variants(df, least_count=1),
        lambda df: lexical_search.ranked_search(df, items),
        lambda df: training_order.write_training_order(df.coalesce(1), new_path(spark, "shards")),
    ):
        plain, clashing = (sorted(map(repr, operator(df).drop("sequence_id").collect())) for df in plain_and_clashing)
        assert plain == clashing and plain, operator


def test_stages_keep_clashing_columns(spark, plain_and_clashing):
    """A stage returns the columns it gets, and the same rows whatever further columns there are."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs, more = plain_and_clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, clashing = stage(spark, docs, SF_DIR), stage(spark, more, SF_DIR)
        assert clashing.columns == more.columns, name
        assert all(r[n] == 7 for r in clashing.collect() for n in CLASHING), name
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, clashing.select(docs.columns).collect())), name
