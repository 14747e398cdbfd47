"""Sources, mining, training groups, encoders and losses."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import aggregates, labels, losses, negatives, scores, training
from gleaner.operators.embedding import embed_texts, hash_words
from gleaner.plans import loading
from gleaner.plans.evaluation import Model, evaluate, search
from gleaner.plans.mining import mine_hard_negatives
from gleaner.plans.testset import build_test_set
from gleaner.sources import tables

WORDS = "red blue green cat dog bird runs flies sleeps far home never".split()


def make_rows(spark, n=40, n_pos=3):
    def text(i, j):
        return " ".join(WORDS[(i * 5 + j * 3 + t * (i + 1)) % 12] for t in range(4)) + f" {i}-{j}"

    rows = [(i, f"q{i % 7} {text(i, 0)}", [text(i, j) for j in range(n_pos)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, query string, pos array<string>")


def test_mined_rows_keep_the_invariants(spark):
    rows = make_rows(spark)
    mined = mine_hard_negatives(rows, lo=2, hi=30, n=5).collect()
    assert len(mined) == 40
    for r in mined:
        assert len(r["neg"]) == len(set(r["neg"])) == 5
        assert not set(r["neg"]) & (set(r["pos"]) | {r["query"]})


def test_mining_does_not_depend_on_partitions(spark):
    rows = make_rows(spark)
    a, b = (
        sorted((r["id"], r["neg"]) for r in mine_hard_negatives(rows.repartition(n), lo=2, hi=30, n=5).collect())
        for n in (1, 7)
    )
    assert a == b


def test_rows_are_filled_up_from_the_pool(spark):
    rows = make_rows(spark, 6)
    mined = mine_hard_negatives(rows, lo=1, hi=3, n=9).collect()
    assert all(len(r["neg"]) == 9 and not set(r["neg"]) & set(r["pos"]) for r in mined)


def test_fillers_come_from_the_whole_corpus(spark):
    """3,000 texts, 300 rows without any negative: far more than a shared list would give are drawn, none twice in a row."""
    rows = spark.range(300).select("id", F.lit("q").alias("query"), F.array(F.lit("p")).alias("pos"))
    corpus = spark.range(3000).select(F.md5(F.concat(F.lit("t"), "id")).alias("text_id"))
    none = spark.createDataFrame([], "id long, text_id string")
    found = negatives.backfill_negatives(rows, none, corpus, n=15).collect()
    by_row = {}
    for r in found:
        by_row.setdefault(r["id"], []).append((r["place"], r["text_id"]))
    assert all(sorted(p for p, _ in v) == list(range(15)) and len({t for _, t in v}) == 15 for v in by_row.values())
    assert len(by_row) == 300
    assert len({r["text_id"] for r in found}) > 1800
    assert len({tuple(t for _, t in sorted(v)) for v in by_row.values()}) == 300


def test_nulls_do_not_cost_negatives(spark):
    schema = "id long, query string, pos array<string>"
    rows = spark.createDataFrame([(1, "q", ["p"]), (2, None, ["p"]), (3, "q", ["p", None]), (4, "q", None)], schema)
    corpus = spark.createDataFrame([(f"t{i}",) for i in range(30)] + [("p",), ("q",)], "text string")
    corpus = corpus.select(F.md5("text").alias("text_id"), "text")
    negs = rows.select("id", F.md5(F.lit("t0")).alias("text_id"))
    found = negatives.backfill_negatives(rows, negs, corpus, n=5).join(corpus, "text_id")
    got = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.countDistinct("text").alias("n")).collect()}
    assert got == {1: 5, 2: 5, 3: 5, 4: 5}
    texts = {(r["id"], r["text"]) for r in found.collect()}
    assert not texts & {(1, "p"), (1, "q"), (2, "p"), (3, "p"), (3, "q"), (4, "q")}


def test_a_small_corpus_is_used_up(spark):
    rows = spark.createDataFrame([(1, "q", ["p"])], "id long, query string, pos array<string>")
    corpus = spark.createDataFrame([(t,) for t in ("a", "b", "p")], "text string").select(F.md5("text").alias("text_id"))
    none = spark.createDataFrame([], "id long, text_id string")
    assert negatives.backfill_negatives(rows, none, corpus, n=15).count() == 2
    assert negatives.backfill_negatives(rows, none, corpus.where("false"), n=15).count() == 0


def test_candidate_pool_replaces_the_corpus(spark):
    pool = spark.createDataFrame([(f"pool text {i % 30}",) for i in range(60)], ["text"])
    mined = mine_hard_negatives(make_rows(spark, 10), pool, lo=0, hi=20, n=5).collect()
    assert all(t.startswith("pool text") for r in mined for t in r["neg"])


def test_negatives_already_there_are_flattened(spark):
    df = spark.createDataFrame([(["a", "b"], ["c", "a"]), (["d"], None)], "pos array<string>, neg array<string>")
    assert {r["text"] for r in negatives.distinct_texts(df).collect()} == {"a", "b", "c", "d"}


def test_training_groups(spark):
    rows = spark.createDataFrame(
        [(1, "q", ["p1", "p2"], ["n1", "n2", "n3"], [0.9, 0.8], [0.1, 0.2, 0.3])],
        "id long, query string, pos array<string>, neg array<string>, pos_scores array<double>, neg_scores array<double>",
    )
    g = training.training_groups(rows, group_size=8, distill=True).first()
    score = dict(zip(["p1", "p2", "n1", "n2", "n3"], [0.9, 0.8, 0.1, 0.2, 0.3]))
    assert len(g["passages"]) == 8 and g["passages"][0] in ("p1", "p2")
    assert max(g["passages"][1:].count(n) for n in ("n1", "n2", "n3")) <= 3  # the list repeated three times
    assert g["teacher_scores"] == [score[p] for p in g["passages"]]
    assert training.training_groups(rows).first()["teacher_scores"] is None
    small = training.training_groups(rows, group_size=4).first()["passages"]
    assert sorted(small[1:]) == ["n1", "n2", "n3"]


def test_training_groups_refuse_bad_rows(spark):
    schema = "id long, query string, pos array<string>, neg array<string>, pos_scores array<double>, neg_scores array<double>"
    bad = spark.createDataFrame([(7, "q", ["p"], ["n"], [None], [0.5])], schema)
    with pytest.raises(Exception, match="hold no number in row 7"):
        training.training_groups(bad, distill=True).collect()
    with pytest.raises(Exception, match="no negatives in row 7"):
        training.training_groups(bad.withColumn("neg", F.array().cast("array<string>"))).collect()


def test_apply_instruction(spark):
    df = spark.createDataFrame([("q1", ["a"], "own"), ("q2", ["b"], None)], "query string, passages array<string>, prompt string")
    got = training.apply_instruction(df, "common", "{}: {}", "P", "{}>{}").collect()
    assert [(r["query"], r["passages"]) for r in got] == [("own: q1", ["P>a"]), ("common: q2", ["P>b"])]
    assert training.apply_instruction(df).collect() == df.collect()


def test_read_training_dirs(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text('{"query": "q1", "pos": ["p"], "neg": ["n"]}\n')
    (tmp_path / "d" / "b.jsonl").write_text('{"query": "q2", "pos": ["p"], "neg": ["n"], "pos_scores": [0.5]}\n')
    (tmp_path / "d" / "c.txt").write_text("no rows\n")
    (tmp_path / "d" / "empty.json").write_text("")
    (tmp_path / "e.jsonl").write_text('{"query": "q3", "pos": ["p"], "neg": ["n"]}\n')
    (tmp_path / "f.csv").write_text("x\n")
    read = tables.read_training_dirs(spark, [str(tmp_path / "d"), str(tmp_path / "e.jsonl"), str(tmp_path / "f.csv")])
    rows = read.orderBy("query").collect()
    assert [(r["query"], os.path.basename(r["file"])) for r in rows] == [("q1", "a.json"), ("q2", "b.jsonl"), ("q3", "e.jsonl")]
    assert rows[1]["pos_scores"] == [0.5] and rows[0]["pos_scores"] is None


def test_score_columns_policy(spark):
    df = spark.createDataFrame([("q", [1.0])], "query string, pos_scores array<double>")
    assert tables.score_columns_policy(df, distill=False).columns == ["query"]
    with pytest.raises(ValueError, match="some.jsonl"):
        tables.score_columns_policy(df, distill=True, file="some.jsonl")


def test_broken_lines_fail_the_read(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": 1, "t": "a"}\n{"id": 2, "t"\nnothing\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(path), "id long, t string").collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_training_dirs(spark, [str(path)], "id long, t string").collect()
    kept = tables.read_jsonl(spark, str(path), "id long, t string", mode="DROPMALFORMED").collect()
    assert [tuple(r) for r in kept] == [(1, "a")]


def test_loading_asks_every_file_for_scores(spark, tmp_path):
    row = {"id": 1, "query": "q", "pos": ["p1", "p2"], "neg": ["n"]}
    scored = row | {"pos_scores": [0.5, 0.4], "neg_scores": [0.1]}
    (tmp_path / "good.jsonl").write_text("\n".join(json.dumps(scored | {"id": i}) for i in range(30)))
    (tmp_path / "bare.jsonl").write_text("\n".join(json.dumps(row | {"id": 100 + i}) for i in range(5)))
    both, good = [str(tmp_path)], [str(tmp_path / "good.jsonl")]
    with pytest.raises(ValueError, match="bare.jsonl") as error:
        loading.load_training_rows(spark, both, distill=True)
    assert "good.jsonl" not in str(error.value)
    groups = loading.load_training_groups(spark, good, group_size=3, distill=True, q_inst="ask", q_fmt="{}: {}")
    assert all(len(r["teacher_scores"]) == 3 and r["query"] == "ask: q" for r in groups.collect())
    capped = loading.load_training_rows(spark, both, max_rows=10)
    assert sorted(r["count"] for r in capped.groupBy("file").count().collect()) == [5, 10]
    assert "pos_scores" not in capped.columns


def test_groups_of_one_need_no_negatives(spark):
    rows = spark.createDataFrame([(1, "q", ["p"], None)], "id long, query string, pos array<string>, neg array<string>")
    assert training.training_groups(rows, group_size=1).first()["passages"] == ["p"]
    with pytest.raises(Exception, match="no negatives in row 1"):
        training.training_groups(rows, group_size=2).select("query").collect()


def test_separators_are_no_patterns(spark):
    df = spark.createDataFrame([("ab|c.d^e",)], "l string")
    for sep, first in (("|", "ab"), (".", "ab|c"), ("^", "ab|c.d")):
        assert labels.count_labels_single(df, "l", sep).first()["label"] == first
        assert labels.count_labels_multi(df, "l", sep).count() == 2


def test_queries_and_passages_have_their_own_encoders(spark):
    """An encoder for either side: the query's says which passage is wanted, which one encoder for both can't."""
    queries = spark.createDataFrame([("1", "one"), ("2", "two")], "id string, text string")
    corpus = spark.createDataFrame([("a", ["uno"]), ("b", ["due"])], "id string, text array<string>")
    axes = {"ask one": [1.0, 0.0], "ask two": [0.0, 1.0], "uno": [1.0, 0.0], "due": [0.0, 1.0]}
    model = Model(lambda: lambda t: np.array([axes[x] for x in t]), lambda: lambda t: np.array([axes[x] for x in t]), "ask", "{} {}")
    best = {r["qid"]: r["docid"] for r in search(queries, corpus, model, k=1).collect()}
    assert best == {"1": "a", "2": "b"}


def test_vector_sums_and_first_rows(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((400, 6))
    rows = [(int(i % 7) if i % 50 else None, i, data[i].tolist() if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, pos int, vec array<double>").repartition(6)
    sums = {r["k"]: r["vec"] for r in aggregates.vector_sum(df, ["k"], "vec").collect()}
    means = {r["k"]: r["vec"] for r in aggregates.vector_mean(df, ["k"], "vec").collect()}
    for key in {k for k, _, _ in rows}:
        own = np.array([v for k, _, v in rows if k == key and v is not None])
        assert sums[key] == pytest.approx(own.sum(axis=0)) and means[key] == pytest.approx(own.mean(axis=0))
    for last in (False, True):
        found = {r["k"]: r["pos"] for r in aggregates.first_by(df, "k", "pos", last).collect()}
        pick = max if last else min
        assert found == {key: pick(p for k, p, _ in rows if k == key) for key in {k for k, _, _ in rows}}


def test_write_jsonl_keeps_order_nulls_and_characters(spark, tmp_path):
    df = spark.range(100).select((99 - F.col("id")).alias("id"), F.when(F.col("id") != 5, "형법").alias("t"))
    tables.write_jsonl(df.repartition(5), str(tmp_path / "out"), "id")
    lines = [
        line for f in sorted(os.listdir(tmp_path / "out")) if f.startswith("part-")
        for line in (tmp_path / "out" / f).read_text().splitlines()
    ]
    assert lines[0] == '{"id":0,"t":"형법"}' and lines[94] == '{"id":94,"t":null}' and len(lines) == 100


def test_user_encoder_runs_on_distinct_texts(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}" if i < 8 else None) for i in range(9)], "id long, t string")

    def make():
        return lambda texts: np.array([[len(t), float(t[-1])] for t in texts])

    got = {r["id"]: r["vec"] for r in embed_texts(df, "t", make, key="id").collect()}
    assert got[4] == [2.0, 1.0] and got[8] is None and len(got) == 9
    told = embed_texts(df.where("t is not null"), "t", make, instruction="xx", dedupe=False).first()
    assert told["vec"][0] == 4.0


def test_hash_words_edge_cases():
    import pyarrow as pa

    vecs = hash_words(pa.array(["", "  ", None, "a a a", "a"]), 16)
    assert not vecs[:3].any()
    np.testing.assert_allclose(vecs[3], vecs[4])
    assert hash_words(pa.array([], pa.string()), 16).shape == (0, 16)


def test_build_test_set(spark):
    rows = [(i, f"fact {i}", "형법 제1조" if i < 11 else "형법 제2조" if i < 21 else "형법 제3조" if i < 30 else "민법") for i in range(40)]
    rows += [(99, "spaced", "형법 제1조, 형법 제2조")]
    facts = spark.createDataFrame(rows, "key long, fact string, laws_service string")
    laws = spark.createDataFrame([(i, f"형법 제{i}조", f"law {i}") for i in (1, 2, 3)] + [(9, "형법 제1조", "later")], "id long, title string, content string")
    queries, corpus, qrels = build_test_set(facts, laws, "형법", 10)
    assert sorted(map(tuple, queries.collect())) == [("1", "law 1"), ("2", "law 2")]
    assert sorted(int(r["id"]) for r in corpus.collect()) == list(range(20))
    assert qrels.groupBy("qid").count().orderBy("qid").collect()[0]["count"] == 10
    assert {(r["qid"], int(r["docid"]) // 10) for r in qrels.collect()} == {("1", 0), ("2", 1)}
    result = evaluate({"hashing": None}, queries, corpus, qrels).first()
    assert 0 <= result["ndcg_at_10"] <= 1


def test_lookup_required_names_the_misses(spark):
    asked = spark.createDataFrame([("a",), ("x",)], ["label"])
    dim = spark.createDataFrame([(1, "a", "t")], "id long, title string, content string")
    with pytest.raises(ValueError, match="no query has the title: x"):
        labels.lookup_required(asked, dim)


def test_ensemble_wants_all_parts(spark):
    def part(name, rows):
        return spark.createDataFrame(rows, f"q_id long, p_id long, {name} double")

    dense, lexical = part("dense", [(1, 1, 0.5), (1, 2, 0.25)]), part("lexical", [(1, 1, 1.0), (1, 2, 0.0)])
    maxsim = part("maxsim", [(1, 1, 0.1)])
    with pytest.raises(ValueError, match="attention"):
        scores.score_ensemble(dense, lexical, maxsim)
    with pytest.raises(Exception, match="a pair lacks scores: maxsim"):
        scores.score_ensemble(dense, lexical, maxsim, with_attention=False).collect()
    only_dense = scores.score_ensemble(dense, lexical, dense.withColumnRenamed("dense", "maxsim"), dense.withColumnRenamed("dense", "attention"), (1.0, 0.0, 0.0, 0.0))
    assert sorted(r["ensemble"] for r in only_dense.collect()) == [0.25, 0.5]


def test_maxsim_keeps_negative_maxima(spark):
    q = spark.createDataFrame([(1, 0, [9.0]), (1, 1, [1.0]), (1, 2, [2.0])], "doc_id long, pos int, vec array<float>")
    p = spark.createDataFrame([(5, 0, [9.0]), (5, 1, [-1.0]), (5, 2, [-3.0])], "doc_id long, pos int, vec array<float>")
    pairs = spark.createDataFrame([(1, 5)], "q_id long, p_id long")
    assert scores.score_maxsim(q, p, pairs, temperature=0.5).first()["maxsim"] == pytest.approx(((-1 - 2) / 2) / 0.5)
    lacking = scores.score_maxsim(q.where("pos = 0"), p, pairs).first()
    assert (lacking["q_id"], lacking["p_id"], lacking["maxsim"]) == (1, 5, None)


def test_blends(spark):
    row = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, 1.0, 2.0, 3.0, 4.0)], "dense double, ensemble double, lexical double, maxsim double, attention double, distill_dense double, distill_lexical double, distill_maxsim double, distill_attention double")
    assert losses.blend_losses(row, "base").first()["loss"] == pytest.approx((1 + 2 + 0.3 + 4) / 4)
    assert losses.blend_losses(row, "attention").first()["loss"] == pytest.approx((1 + 2 + 0.3 + 4 + 0.5) / 5)
    both = ((1 + 2 + 0.3 + 4 + 0.5) / 5 + (1 + 0.2 + 3 + 0.4) / 4) / 2
    assert losses.blend_losses(row, "attention", self_distill=True).first()["loss"] == pytest.approx(both)
