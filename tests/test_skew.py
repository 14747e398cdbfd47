"""Hot keys, cut blocks and copies give the same results as the plain way."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions.digests import md5_many
from gleaner.operators import attention, cells, knn, losses, metrics, negatives, sampling, scores
from gleaner.operators.aggregates import log_sum_exp
from gleaner.operators.knn import block_counts, knn_pruned, knn_topk
from gleaner.operators.skew import hot_keys, left_join_hot_right, skew_join


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key; NULL keys too."""
    return spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 40).cast("string")).alias("k"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, hot, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3), ("2", 4), (None, 5)], "k string, v int")
    columns = ["id", "k"] + (["v"] if how in ("inner", "left") else [])
    dealt = skew_join(hot, right, ["k"], how, ["id"], hot_rows=20)
    assert rows_of(dealt, *columns) == rows_of(hot.join(right, ["k"], how), *columns)


def test_skew_join_deals_both_sides(spark, hot):
    right = hot.select("k", F.col("id").alias("rid"))
    dealt = skew_join(hot, right, ["k"], "inner", ["id"], ["rid"], hot_rows=30)
    assert rows_of(dealt, "id", "rid") == rows_of(hot.join(right, ["k"]), "id", "rid")


def test_left_join_with_a_hot_right_side(spark, hot):
    left = spark.createDataFrame([("hot", 1), ("1", 2), ("nowhere", 3), (None, 4)], "k string, v int")
    dealt = left_join_hot_right(left, hot, ["k"], ["id"], hot_rows=20)
    assert rows_of(dealt, "k", "v", "id") == rows_of(left.join(hot, ["k"], "left"), "k", "v", "id")


def test_hot_keys_lists_only_hot_ones(hot):
    assert [r["_shares"] for r in hot_keys(hot, ["k"], 100).collect()] == [2]


def test_any_number_of_hot_keys_is_dealt(spark, hot, monkeypatch):
    """Beyond the broadcast bound the table of hot keys is joined, and no hot key is left out."""
    from gleaner.operators import skew

    monkeypatch.setattr(skew, "MOST_BROADCAST", 2)
    right = hot.select("k", F.col("id").alias("rid"))
    dealt = skew_join(hot, right, ["k"], "inner", ["id"], ["rid"], hot_rows=5)
    assert rows_of(dealt, "id", "rid") == rows_of(hot.join(right, ["k"]), "id", "rid")


def test_large_samples_equal_the_ranked_ones(spark):
    df = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "a").otherwise((F.col("id") % 2).cast("string")).alias("g"))
    k = 3000
    large = sampling.sample_per_group(df, "g", "id", k)
    spark.conf.set(sampling.RANK_SETTING, "1000000")
    try:
        ranked = sampling.sample_per_group(df, "g", "id", k)
    finally:
        spark.conf.unset(sampling.RANK_SETTING)
    assert rows_of(large, "g", "id") == rows_of(ranked, "g", "id")
    assert large.groupBy("g").count().where("count <> 3000").count() == 0


@pytest.mark.parametrize("k", [900, 1500])
def test_cap_rows_keeps_rows_without_a_file(spark, k):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 != 0, "f").alias("file"))
    sizes = {r["file"]: r["count"] for r in sampling.cap_rows(df, "file", "id", k).groupBy("file").count().collect()}
    assert sizes == {"f": k, None: k}


def test_only_the_cut_bucket_is_ranked(spark):
    """The rows that a rank is computed for are a small share of those kept."""
    df = spark.range(200_000).select(F.col("id"), F.lit("g").alias("g"))
    kept = sampling.sample_per_group(df, "g", "id", 100_000)
    assert kept.count() == 100_000
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "row_number()" in line and "Window" in line)
    assert plan.count("row_number()") == 1 and "_in" in window
    assert "_room#" in plan and "< count#" in plan


def test_sample_k_per_class_refuses_small_classes(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(20)], "id long, g string")
    with pytest.raises(ValueError, match=r"a \(9\)"):
        sampling.sample_k_per_class(df, "g", "id", 10)


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((300, 8)).astype(np.float32)
    data[100:200] = data[0]  # a third are copies of one vector
    rows = [(i, i // 4, 0 if i < 200 else i % 5, [float(x) for x in v]) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "id long, doc long, label int, vec array<float>")


def brute(q, c, c_ids, k):
    s = np.round(q.astype(np.float64) @ c.astype(np.float64).T, 10)
    out = []
    for i, row in enumerate(s):
        best = {}
        for j, score in zip(c_ids, row):
            best[j] = max(best.get(j, -math.inf), score)
        ranked = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
        out += [(i, j, n + 1) for n, (j, _) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("blocks", [(1, 1), (3, 1), (1, 4), (4, 5), None])
def test_knn_equals_brute_force_with_copies(vecs, blocks):
    data, df = vecs
    q = df.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    c = df.select(F.col("id").alias("c_id"), F.col("vec").alias("c_vec"))
    got = rows_of(knn_topk(q, c, 20, blocks=blocks), "q_id", "c_id", "rank")
    assert got == sorted(brute(data, data, range(300), 20), key=repr)


@pytest.mark.parametrize("blocks", [(1, 1), (2, 5)])
def test_knn_ranks_documents_by_their_best_passage(vecs, blocks):
    data, df = vecs
    q = df.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    c = df.select(F.col("doc").alias("c_id"), F.col("vec").alias("c_vec"))
    got = rows_of(knn_topk(q, c, 7, blocks=blocks, unique_ids=False), "q_id", "c_id", "rank")
    assert got == sorted(brute(data, data, [i // 4 for i in range(300)], 7), key=repr)


def test_knn_string_ids_fewer_rows_than_k_and_null_vectors(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)], "id string, vec array<float>")
    q, c = df.selectExpr("id q_id", "vec q_vec"), df.selectExpr("id c_id", "vec c_vec")
    got = rows_of(knn_topk(q, c, 5), "q_id", "c_id", "rank")
    assert got == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2)]


def test_block_counts_are_bounded():
    for nq, nc in ((10, 10), (10**6, 10**9), (10**9, 10**3), (1, 10**10)):
        bq, bc = block_counts(nq, nc, 100, 1024, 1000)
        rows = cells.block_rows(1024)
        assert nq / bq <= rows and nc / bc <= rows


@pytest.mark.parametrize("rows", [1000, 16])
def test_attention_and_category_vectors(vecs, rows):
    data, df = vecs
    x = data.astype(np.float64)
    labels = np.array([0 if i < 200 else i % 5 for i in range(300)])
    qkv = df.select("id", "label", *[F.col("vec").alias(c) for c in "qkv"])
    attended = {r["id"]: r["attended"] for r in attention.self_attention_vectors(qkv, "label", rows=rows).collect()}
    category = {r["id"]: r["category"] for r in attention.category_vectors(df, "label", rows=rows).collect()}
    assert len(attended) == len(category) == 300
    for label in set(labels):
        at = np.flatnonzero(labels == label)
        e = x[at]
        s = np.exp(e @ e.T / math.sqrt(8))
        want = (s / s.sum(1, keepdims=True)) @ e
        np.testing.assert_allclose([attended[i] for i in at], want, atol=1e-9)
        s = np.exp(e @ e.T)
        np.testing.assert_allclose([category[i] for i in at], (s / s.sum(0, keepdims=True)) @ e, atol=1e-9)


def test_attention_heads(vecs):
    data, df = vecs
    x = data.astype(np.float64)[:200]
    qkv = df.where("label = 0 and id < 200").select("id", "label", *[F.col("vec").alias(c) for c in "qkv"])
    got = {r["id"]: r["attended"] for r in attention.self_attention_vectors(qkv, "label", heads=2).collect()}
    want = []
    for part in (x[:, :4], x[:, 4:]):
        s = np.exp(part @ part.T / 2)
        want.append((s / s.sum(1, keepdims=True)) @ part)
    np.testing.assert_allclose([got[i] for i in range(200)], np.hstack(want), atol=1e-9)


@pytest.mark.parametrize("rows", [1000, 16])
def test_in_batch_loss_equals_brute_force(vecs, rows):
    data, df = vecs
    x = data.astype(np.float64)
    passages = df.select("label", F.col("id").alias("group"), F.lit(True).alias("is_target"), "id", "vec")
    loss = losses.in_batch_loss(df, passages, "label", temperature=0.5, rows=rows).first()["loss"]
    labels = np.array([0 if i < 200 else i % 5 for i in range(300)])
    want = []
    for i in range(300):
        s = x[i] @ x[labels == labels[i]].T / 0.5
        want.append(np.log(np.exp(s - s.max()).sum()) + s.max() - x[i] @ x[i] / 0.5)
    assert loss == pytest.approx(np.mean(want), abs=1e-9)


def test_log_sum_exp_of_any_size(spark):
    values = {"a": [1e4, 1e4 - 1, 0.0], "b": [-1e4, -1e4 - 2], "c": [250.0, 249.9, -700.0], "d": [750.0, 749.0, 251.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    for row in log_sum_exp(df, ["k"], "v").collect():
        v = np.array(values[row["k"]])
        assert row["lse"] == pytest.approx(v.max() + np.log(np.exp(v - v.max()).sum()), abs=1e-9)


def test_scores_with_hot_documents(spark, monkeypatch):
    from gleaner.operators import skew

    tokens = spark.range(400).select(
        F.when(F.col("id") < 140, 0).otherwise(F.floor(F.col("id") / 10)).alias("doc_id"),
        F.when(F.col("id") < 140, F.col("id")).otherwise(F.col("id") % 10).cast("int").alias("pos"),
        F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(4)]).alias("vec"),
        (F.col("id") % 13).cast("string").alias("token"), F.sin(F.col("id")).alias("weight"),
    )
    docs = tokens.select("doc_id").distinct()
    pairs = docs.select(F.col("doc_id").alias("q_id"), F.explode(F.array(F.lit(0), "doc_id")).alias("p_id")).distinct()
    weights = scores.lexical_weights(tokens)
    dense = tokens.where("pos = 1").select(F.col("doc_id").alias("id"), "vec")

    def all_scores():
        return [
            rows_of(df.withColumn("s", F.round(name, 9)), "q_id", "p_id", "s")
            for name, df in (
                ("dense", scores.score_dense(dense, dense, pairs)),
                ("lexical", scores.score_lexical(weights, weights, pairs)),
                ("maxsim", scores.score_maxsim(tokens, tokens, pairs)),
            )
        ]

    plain = all_scores()
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(scores, "HOT_PAIRS", 5)
    assert all_scores() == plain
    monkeypatch.setattr(scores, "TOKEN_BLOCK", 4)
    monkeypatch.setattr(scores, "MAP_TOKENS", 3)
    assert all_scores() == plain
    assert len(plain[0]) == pairs.count()


def test_a_list_goes_once_to_each_cell_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(d, f"t{t}", float(rng.integers(0, 3))) for d in range(200) for t in rng.choice(40, 12, replace=False)]
    weights = spark.createDataFrame(rows, "doc_id long, token string, weight double")
    pairs = [(q, q + i) for q in range(200) for i in range(8)] + [(3, 190), (3, 4), (None, 4), (4, None), (500, 1)]
    asked = spark.createDataFrame(pairs, "q_id long, p_id long")
    lists = {}
    for d, t, w in rows:
        lists.setdefault(d, {})[t] = w
    want = sorted((str(q), str(p), sum(w * lists.get(p, {}).get(t, 0.0) for t, w in lists.get(q, {}).items())) for q, p in pairs)

    def got(q, p):
        return sorted((str(r["q_id"]), str(r["p_id"]), r["lexical"]) for r in scores.score_lexical(q, p, asked).collect())

    assert got(weights, weights) == want == got(weights, weights.select("*"))
    monkeypatch.setattr(scores, "CELL_BYTES", 50_000)  # some 128 pairs of two lists of 12 tokens
    assert got(weights, weights) == want == got(weights, weights.select("*"))
    sizes = scores._sizes(weights.selectExpr("doc_id AS _id", "token AS _t", "weight AS _w"))
    near = asked.where("p_id BETWEEN q_id AND q_id + 7")
    celled = scores._celled(near, sizes, sizes)
    assert celled.count() == near.count()
    needed = celled.select("_cell", F.explode(F.array("q_id", "p_id"))).distinct().count()
    assert celled.select("_cell").distinct().count() > 8 and needed < 500  # 1,600 with one for each pair
    # A weight that is no number reaches the score through a weight of zero too.
    odd = spark.createDataFrame([(1, "a", 0.0), (2, "a", float("nan"))], "doc_id long, token string, weight double")
    pair = spark.createDataFrame([(1, 2)], "q_id long, p_id long")
    assert np.isnan(scores.score_lexical(odd, odd, pair).first()["lexical"])


def test_qrels_map_in_parts(spark):
    qrels = spark.range(1000).select(
        F.when(F.col("id") < 600, "q0").otherwise(F.concat(F.lit("q"), F.col("id") % 9)).alias("qid"),
        F.col("id").cast("string").alias("docid"), F.lit(1.0).alias("relevance"),
    )
    maps = metrics.qrels_map(qrels, parts=8).collect()
    assert sum(len(r["judgements"]) for r in maps) == 1000
    assert max(len(r["judgements"]) for r in maps) < 200
    assert {r["part"] for r in maps} == set(range(8))
    assert len({r["qid"] for r in metrics.qrels_map(qrels).collect()}) == metrics.qrels_map(qrels).count()


def test_in_batch_losses_do_not_depend_on_blocks(spark):
    """All scores of a batch against brute force, the batch in one block and cut in many."""
    rng = np.random.default_rng(3)
    docs = []
    for i in range(60):
        tokens = rng.standard_normal((int(rng.integers(1, 4)), 4))
        words = rng.choice(9, 3, replace=False).tolist()
        docs.append((i, 0 if i < 45 else 1, rng.standard_normal(4), tokens, {str(w): float(w) / 9 for w in words}))

    def rows(turn):
        return [
            (b, i, (turn * v).tolist(), t.ravel().tolist(), 4, list(w.items()), i, True) for i, b, v, t, w in docs
        ]

    schema = "batch int, id long, dense array<double>, tokens array<double>, token_dim int, lexical array<struct<token:string,weight:double>>, group long, is_target boolean"
    q, p = spark.createDataFrame(rows(1.0), schema), spark.createDataFrame(rows(-0.5), schema)
    weights = {"dense": 1.0, "lexical": 0.3, "maxsim": 0.5}
    want = {n: [] for n in [*weights, "ensemble"]}
    for i, b, v, t, w in docs:
        own = [d for d in docs if d[1] == b]
        s = {
            "dense": np.array([-0.5 * v @ d[2] for d in own]),
            "lexical": np.array([sum(x * d[4].get(k, 0.0) for k, x in w.items()) for d in own]),
            "maxsim": np.array([(t @ d[3].T).max(axis=1).mean() for d in own]),
        }
        s["ensemble"] = sum(weights[n] * s[n] for n in weights)
        at = [d[0] for d in own].index(i)
        for n in want:
            x = s[n] / 0.5
            want[n].append(np.log(np.exp(x).sum()) - x[at])
    for rows_in_block in (512, 7):
        got = losses.in_batch_losses(q, p, "batch", list(weights), weights, 0.5, rows=rows_in_block).first().asDict()
        assert got == pytest.approx({n: float(np.mean(v)) for n, v in want.items()})


def _sides(spark, queries, corpus):
    as_rows = lambda m: [(i, v.tolist()) for i, v in enumerate(m)]
    q = spark.createDataFrame(as_rows(queries), "q_id long, q_vec array<float>")
    return q, spark.createDataFrame(as_rows(corpus), "c_id long, c_vec array<float>")


@pytest.mark.parametrize("kind", ["clusters", "no clusters", "copies"])
@pytest.mark.parametrize("block_bytes", [None, 1])
def test_pruned_search_finds_the_same_rows(spark, kind, block_bytes):
    rng = np.random.default_rng(11)
    spread = 0.05 if kind == "clusters" else 1.0
    centres = rng.standard_normal((20, 16)) * (1 if kind == "clusters" else 0.0)
    corpus = (centres[rng.integers(0, 20, 3000)] + spread * rng.standard_normal((3000, 16))).astype(np.float32)
    queries = (centres[rng.integers(0, 20, 200)] + spread * rng.standard_normal((200, 16))).astype(np.float32)
    if kind == "copies":
        corpus[500:2500] = corpus[0]
        queries[:150] = corpus[0]
    q, c = _sides(spark, queries, corpus)
    told = []
    found = knn_pruned(q, c, 15, n_blocks=40, block_bytes=block_bytes, report=told.append)
    want = knn_topk(q, c, 15)
    assert rows_of(found, "q_id", "c_id", "score", "rank") == rows_of(want, "q_id", "c_id", "score", "rank")
    skipped = float(told[0].split("%")[0].split()[-1])
    assert (skipped > 60) if kind == "clusters" else (0 <= skipped < 100)


def test_pruned_search_of_few_rows_null_vectors_and_nothing(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None)], "id string, vec array<float>")
    q, c = df.selectExpr("id q_id", "vec q_vec"), df.selectExpr("id c_id", "vec c_vec")
    got = rows_of(knn_pruned(q, c, 5), "q_id", "c_id", "rank")
    assert got == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1), ("b", "b", 2)]
    assert knn_pruned(q.limit(0), c, 5).collect() == [] == knn_pruned(q, c.where("false"), 5).collect()


def test_each_cell_has_its_own_partition(spark):
    for n in (1, 2, 7, 64, 1000):
        keys = spark.createDataFrame([(k,) for k in cells.spread_keys(n)], "k int")
        assert sorted(r[0] for r in keys.select(F.expr(f"pmod(hash(k), {n})")).collect()) == list(range(n))


def test_cells_are_shuffled_once(vecs):
    _, df = vecs
    q, c = df.selectExpr("id q_id", "vec q_vec"), df.selectExpr("id c_id", "vec c_vec")
    plan = knn_topk(q, c, 5, blocks=(3, 1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan


def test_hits_a_task_holds_are_bounded():
    for nq, nc, k in ((10**6, 10**6, 210), (615_000, 615_000, 100), (10**5, 10**5, 10_000)):
        bq, _ = block_counts(nq, nc, k, 64, 12)
        assert nq / bq * k * 16 <= cells.BLOCK_BYTES


def test_a_task_takes_several_corpus_blocks():
    """Each corpus block hands back k hits of every query: 30 of them made 3 billion hits of 500,000 queries."""
    assert block_counts(512_820, 3_900_000, 210, 64, 12)[1] == 30
    bq, bc = block_counts(512_820, 3_900_000, 210, 64, 12, run=8)
    assert bc == 4 and bq * bc >= 12


def test_scores_closer_than_single_precision(spark):
    """Scores differ by less than single precision tells apart, and many tie; ids come in no order."""
    rng = np.random.default_rng(5)
    corpus = np.ones((5000, 8)) / math.sqrt(8) + rng.integers(0, 40, (5000, 1)) * 1e-9
    queries = corpus[:300] * rng.uniform(0.5, 2, (300, 1))
    as_rows = lambda m: [(i, v.tolist()) for i, v in enumerate(m)]
    q = spark.createDataFrame(as_rows(queries), "q_id long, q_vec array<double>")
    c = spark.createDataFrame(as_rows(corpus)[::-1], "c_id long, c_vec array<double>")
    want = {(i, j): n for i, j, n in brute(queries, corpus, range(5000), 30)}
    for blocks in ((2, 1), (1, 3)):
        got = {(r["q_id"], r["c_id"]): r["rank"] for r in knn_topk(q, c, 30, blocks=blocks).collect()}
        assert len(got) == len(want) and len(got.keys() & want.keys()) > 0.99 * len(want)  # a sum may round otherwise


def test_pruned_search_moves_queries_once_per_cell(spark, monkeypatch):
    """A query that no bound keeps from any block goes to each cell, not to each block."""
    rng = np.random.default_rng(3)
    q, c = _sides(spark, rng.standard_normal((300, 16)), rng.standard_normal((3000, 16)))
    moved, plain = [], knn._in_stream

    def counted(q, c, q_cells, c_cells, cells, *more):
        moved.append((q.select(F.sum(F.size(q_cells))).first()[0], c.select(F.sum(F.size(c_cells))).first()[0], cells))
        return plain(q, c, q_cells, c_cells, cells, *more)

    monkeypatch.setattr(knn, "_in_stream", counted)
    assert knn_pruned(q, c, 15, n_blocks=100).count() == 300 * 15
    (begun, _, _), (further, corpus, n_cells) = moved
    assert begun <= 300 * 4 and further <= 300 * n_cells and corpus <= 3000 * n_cells and n_cells <= 8


def brute_lists(q, c, k):
    scores = np.rint(q.astype(np.float64) @ c.astype(np.float64).T * 1e10)
    return {i: np.lexsort((np.arange(len(c)), -row))[:k].tolist() for i, row in enumerate(scores)}


@pytest.mark.parametrize("blocks", [None, (1, 1), (3, 1), (2, 3)])
@pytest.mark.parametrize("scaled", [False, True])
def test_lists_of_hits_equal_brute_force(spark, monkeypatch, blocks, scaled):
    """A query is one row, whatever the blocks, and a task lets go of ids that are no hits."""
    monkeypatch.setattr(knn, "MOST_IDS", 300)
    rng = np.random.default_rng(4)
    q, c = rng.integers(-3, 4, (40, 10)).astype(np.float32), rng.integers(-3, 4, (900, 10)).astype(np.float32)  # many ties
    if scaled:
        q, c = q * rng.random((40, 1)).astype(np.float32), c * 10 ** rng.uniform(-4, 4, (900, 1)).astype(np.float32)
    schema = "id long, vec array<float>"
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], schema).toDF("q_id", "q_vec")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)] + [(900, None)], schema).toDF("c_id", "c_vec")
    corpus = corpus.repartition(5).withColumn("name", F.concat(F.lit("n"), "c_id"))
    found = knn_topk(queries, corpus, 7, blocks=blocks, lists="name").collect()
    assert len(found) == 40
    assert {r["q_id"]: r["hits"] for r in found} == {i: [f"n{x}" for x in hits] for i, hits in brute_lists(q, c, 7).items()}


@pytest.mark.parametrize("dim,k", [(64, 5), (64, 210), (300, 5)])
def test_rounded_products_miss_nothing(dim, k):
    """Slabs in lanes and without find the same best rows, also where ids are let go in between."""
    rng = np.random.default_rng(dim + k)
    q, c = rng.normal(size=(30, dim)).astype(np.float32), rng.normal(size=(9000, dim)).astype(np.float32)
    c[4000:4300] = q[rng.integers(0, 30, 300)] + rng.normal(size=(300, dim)).astype(np.float32) / 1000  # close scores
    c[5000:5200] = 0
    c[6000:6010] *= 1e6
    q[7] = 0
    corpus = knn._Corpus(pa.int64())
    best, names, laned = knn._Best(q.astype(np.float64), k, True, corpus), [], 0
    for at in range(0, 9000, 250):
        slab = knn._Slab(c[at : at + 250])
        before = corpus.n
        corpus.add(pa.array(range(at, at + 250), pa.int64()))
        best.add(slab, before)
        laned += bool(best.parts and slab.lanes is not None)
        if at % 1000 == 0:
            corpus.shrink([best])
            assert corpus.n <= 30 * k
    row, col, *_ = best.cut()
    ids = corpus.ids.combine_chunks().to_numpy()[col]
    assert {i: ids[row == i].tolist() for i in range(30)} == brute_lists(q, c, k)
    assert laned > 20


def test_pairs_are_few_after_rounded_products(monkeypatch):
    """Of normal vectors hardly any pair that is no hit is looked at in double precision."""
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(64, 64)), rng.normal(size=(30000, 64)).astype(np.float32)
    corpus, asked = knn._Corpus(pa.int64()), []
    plain = knn._Best._ask
    monkeypatch.setattr(knn._Best, "_ask", lambda self, slab, first, row, col: asked.append(len(row)) or plain(self, slab, first, row, col))
    monkeypatch.setattr(knn._Best, "_exact", None)
    best = knn._Best(q, 10, True, corpus)
    for at, end in knn._cuts(0, 30000, True):
        corpus.add(pa.array(range(at, end), pa.int64()))
        best.add(knn._Slab(c[at:end]), at)
    assert sum(asked) < 64 * 30000 / 500


def test_lists_are_cut_and_drawn_as_rows_are(spark):
    ids = [(i % 50, f"t{i}") for i in range(2000)] + [(None, f"t{i}") for i in range(30)]
    pairs = spark.createDataFrame(ids, "id long, text string").select("id", F.md5("text").alias("text_id"))
    rows = spark.createDataFrame([(i, f"t{i}", [f"t{i + 50}", None, f"t{i + 100}"]) for i in range(45)] + [(44, None, ["t194"])],
                                 "id long, query string, pos array<string>")
    lists = pairs.groupBy("id").agg(F.transform(F.collect_list("text_id"), lambda t: F.unhex(t)).alias("hits"))

    def found(df):
        return sorted((str(r["id"]), r["text_id"]) for r in df.select("id", "text_id").collect())

    by_row = negatives.sample_negatives(negatives.exclude_known(pairs, rows), 9)
    by_list = negatives.sample_negatives(negatives.exclude_known(lists, rows, lists="hits"), 9, lists="hits")
    assert found(by_list) == found(by_row)
    ranked = sampling.rank_range(spark.createDataFrame([(list(range(40)),)], "hits array<int>"), 10, 30, lists="hits")
    assert ranked.first()["hits"] == list(range(10, 30))


def test_mining_makes_no_row_of_a_hit(spark, monkeypatch):
    """Hits become rows only after n of them are drawn: at 210 a query they were sorted and joined one by one."""
    from gleaner.plans import mining

    sizes, plain = [], mining.sample_negatives
    monkeypatch.setattr(mining, "sample_negatives", lambda cands, *a, **b: sizes.append(cands.count()) or plain(cands, *a, **b))
    rows = spark.range(60).select("id", F.concat(F.lit("a b "), "id").alias("query"), F.array(F.concat(F.lit("b c "), "id")).alias("pos"))
    assert mining.mine_hard_negatives(rows, lo=2, hi=30, n=5).where("size(neg) = 5").count() == 60
    assert sizes == [60]


def test_md5_of_many_strings():
    rng = np.random.default_rng(0)
    texts = [rng.bytes(int(n)) for n in rng.integers(0, 80, 5000)] + [b"", b"a" * 55, b"b" * 56, b"c" * 64]
    found = md5_many(np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])))
    assert [bytes(row) for row in found] == [hashlib.md5(t).digest() for t in texts]


def test_lists_come_from_the_whole_corpus_for_any_k(spark, monkeypatch):
    """Where there are queries for all workers; with few hits a query, two parts would move fewer vectors."""
    cells = []
    monkeypatch.setattr(knn, "_listed", lambda q, c, k, n: cells.append(n) or q)
    workers = spark.sparkContext.defaultParallelism
    q = spark.range(workers * knn.MIN_BLOCK).select(F.col("id").alias("q_id"), F.array(F.lit(1.0)).alias("q_vec"))
    c = spark.range(40 * workers * knn.MIN_BLOCK).select(F.col("id").alias("c_id"), F.array(F.lit(1.0)).alias("c_vec"))
    for k in (1, 30):
        knn_topk(q, c, k, dim=64, lists="c_id")
        assert block_counts(q.count(), c.count(), 1, 64, max(workers, 8), run=knn.RUN_BLOCKS)[1] > 1
    assert cells == [workers, workers]
