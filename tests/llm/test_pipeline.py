"""The whole pipeline, stage by stage, on the smallest tables."""

import corpus_pipeline
from gleaner.llm.common import Scratch
from test_tokens import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark, docs):
    scratch, kept, before = Scratch(spark, "t"), docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, scratch.keep(stage(spark, kept, SF))
        assert kept.columns == docs.columns, name
        if name != "mixture":
            assert kept.count() <= before.count()
    packed = corpus_pipeline.run(spark, SF).collect()
    check_pieces(packed, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_order_of_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixture", "packing"]


def test_empty_tables(spark, empty):
    kept = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        assert kept.collect() == []
