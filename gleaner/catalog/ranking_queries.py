"""Queries over search, mining and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.catalog.inputs import (
    MODELS, QRELS_SQL, TRAINING_SQL, decisions, hits_sql, laws, model_vector, qrels, training_rows, vectors,
)
from gleaner.catalog.registry import query
from gleaner.catalog.relation_queries import TEST_SET_SQL, hashing_sql
from gleaner.operators import metrics, negatives, sampling
from gleaner.operators.knn import knn_pruned, knn_topk
from gleaner.plans.evaluation import Model, evaluate
from gleaner.plans.mining import mine_hard_negatives, mine_negative_ids
from gleaner.plans.testset import build_test_set
from gleaner.session import new_path
from gleaner.sources.tables import table_roundtrip

DEPTH = 100


def self_search(spark: SparkSession, sf_dir: str, k: int, model: str = "plain") -> DataFrame:
    """Every vector as a query over all vectors, as the model has them."""
    q = vectors(spark, sf_dir).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    c = vectors(spark, sf_dir).select(F.col("id").alias("c_id"), model_vector(model, "vec").alias("c_vec"))
    return knn_topk(q, c, k, dim=64)


def hits(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    found = self_search(spark, sf_dir, DEPTH, model)
    return found.select(
        F.lit(model).alias("model"), F.col("q_id").cast("string").alias("qid"),
        F.col("c_id").cast("string").alias("docid"), "score",
    )


def _search_sql(k: int) -> str:
    return f"""
found AS (
  SELECT q.vec_id AS q_id, c.vec_id AS c_id,
         round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS score
  FROM embeddings q, embeddings c
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY
    round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) DESC, c.vec_id) <= {k}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS rank FROM found)"""


@query(
    "knn_topk",
    f"WITH {_search_sql(DEPTH)} SELECT q_id, c_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_search(spark, sf_dir, DEPTH).withColumn("score", F.round("score", 6))


# The nearest vectors of each, with blocks that can't hold one left out before any product.
@query(
    "knn_pruned",
    f"WITH {_search_sql(10)} SELECT q_id, c_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    c = vectors(spark, sf_dir).select(F.col("id").alias("c_id"), F.col("vec").alias("c_vec"))
    return knn_pruned(q, c, 10).withColumn("score", F.round("score", 6))


@query(
    "knn_best_passage",
    """WITH scored AS (
  SELECT q.vec_id AS q_id, c.vec_id // 10 AS c_id,
         max(round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10)) AS score
  FROM embeddings q, embeddings c GROUP BY 1, 2)
SELECT q_id, c_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) AS INTEGER) AS rank
FROM scored QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id) <= 20""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors(spark, sf_dir).select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    c = vectors(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("c_id"), F.col("vec").alias("c_vec"))
    return knn_topk(q, c, 20, unique_ids=False).withColumn("score", F.round("score", 6))


@query("rank_range", f"WITH {_search_sql(210)} SELECT q_id, c_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank > 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rank_range(self_search(spark, sf_dir, 210)).select("q_id", "c_id", "rank")


# Candidates of a row: its own lines and sentences, and the first lines of the ten rows after it.
_CANDIDATES_SQL = f"""{TRAINING_SQL},
candidates AS (
  SELECT DISTINCT id, md5(t) AS text_id FROM (
    SELECT id, unnest(list_concat(pos, neg)) AS t FROM training
    UNION ALL SELECT a.id, b.query FROM training a JOIN training b ON b.id BETWEEN a.id + 1 AND a.id + 10)),
known AS (
  SELECT id, md5(unnest(pos)) AS text_id FROM training UNION SELECT id, md5(query) FROM training),
unknown AS (SELECT * FROM candidates ANTI JOIN known USING (id, text_id))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    own = rows.select("id", F.explode(F.concat("pos", "neg")).alias("t"))
    offset = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("offset")
    later = rows.select(offset, "id", "query").select((F.col("id") - F.col("offset")).alias("id"), F.col("query").alias("t"))
    later = later.join(rows.select("id"), "id", "left_semi")
    return own.union(later).select("id", F.md5("t").alias("text_id")).distinct()


@query("exclude_known", f"WITH {_CANDIDATES_SQL} SELECT id, text_id FROM unknown")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.exclude_known(_candidates(spark, sf_dir), training_rows(spark, sf_dir))


@query(
    "sample_negatives",
    f"""WITH {_CANDIDATES_SQL}
SELECT id, text_id FROM unknown QUALIFY row_number() OVER
  (PARTITION BY id ORDER BY md5('42:neg:' || id || ':' || text_id), text_id) <= 15""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = negatives.exclude_known(_candidates(spark, sf_dir), training_rows(spark, sf_dir))
    return negatives.sample_negatives(unknown).select("id", "text_id")


def _backfill_sql(have: str, corpus: str) -> str:
    """From rows in `training`, picks in `have` (id, text_id) and `corpus` (text_id)."""
    return f"""
numbered AS (SELECT text_id, row_number() OVER (ORDER BY md5('42:pool:' || text_id), text_id) - 1 AS spot FROM {corpus}),
size AS (SELECT count(*) AS n FROM numbered),
steps AS (
  SELECT list(step ORDER BY i) AS steps FROM (
    SELECT i, 1 + i * 7919 % n AS step FROM size, (SELECT unnest(range(3200)) AS i)
    WHERE gcd(1 + i * 7919 % n, n) = 1 ORDER BY i LIMIT (SELECT least(64, n) FROM size))),
held AS (
  SELECT t.id, list_distinct(list_concat(list_transform(pos, lambda p: md5(p)), [md5(query)], coalesce(h.have, []::VARCHAR[]))) AS passed,
         coalesce(h.have, []::VARCHAR[]) AS have,
         ('0x' || substr(md5('42:fill:' || t.id), 1, 15))::BIGINT % n AS start,
         steps[('0x' || substr(md5('42:step:' || t.id), 1, 15))::BIGINT % len(steps) + 1] AS step, n
  FROM training t LEFT JOIN (SELECT id, list(text_id ORDER BY text_id) AS have FROM {have} GROUP BY id) h ON h.id = t.id
  CROSS JOIN size CROSS JOIN steps),
looks AS (
  SELECT id, passed, len(have) AS had, j, (start + j * step) % n AS spot FROM (
    SELECT *, unnest(range(least(len(passed) + 15 - len(have), n))) AS j FROM held WHERE len(have) < 15)),
free AS (
  SELECT id, text_id, had, row_number() OVER (PARTITION BY id ORDER BY j) AS r FROM looks JOIN numbered USING (spot)
  WHERE NOT list_contains(passed, text_id)),
filled AS (
  SELECT id, CAST(had + r - 1 AS INTEGER) AS place, text_id FROM free WHERE r <= 15 - had
  UNION ALL
  SELECT id, CAST(n - 1 AS INTEGER), text_id FROM (
    SELECT id, unnest(have) AS text_id, generate_subscripts(have, 1) AS n FROM held))"""


@query(
    "backfill_negatives",
    f"""WITH {_CANDIDATES_SQL},
few AS (
  SELECT id, text_id FROM unknown QUALIFY row_number() OVER
    (PARTITION BY id ORDER BY md5('42:neg:' || id || ':' || text_id), text_id) <= 6),
corpus AS (SELECT DISTINCT md5(t) AS text_id FROM (SELECT unnest(list_concat(pos, neg)) AS t FROM training)),
{_backfill_sql("few", "corpus")}
SELECT id, place, text_id FROM filled""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    few = negatives.sample_negatives(negatives.exclude_known(_candidates(spark, sf_dir), rows), 6)
    return negatives.backfill_negatives(rows, few, negatives.distinct_texts(rows))


@query(
    "mine_hard_negatives",
    f"""WITH {TRAINING_SQL},
corpus AS (SELECT DISTINCT md5(text) AS text_id, text FROM (SELECT unnest(pos) AS text FROM training)),
asked AS (SELECT id AS tid, query AS text FROM training),
passages AS (SELECT text_id AS tid, text FROM corpus),
{hashing_sql("asked", "q")}, {hashing_sql("passages", "c")},
scored AS (
  SELECT q.tid AS id, c.tid AS text_id, round(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]), 10) AS score FROM q, c),
ranked AS (
  SELECT id, text_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, text_id) AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, text_id) <= 210),
known AS (
  SELECT id, md5(unnest(pos)) AS text_id FROM training UNION SELECT id, md5(query) FROM training),
picked AS (
  SELECT id, text_id FROM ranked ANTI JOIN known USING (id, text_id) WHERE rank > 10
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('42:neg:' || id || ':' || text_id), text_id) <= 15),
{_backfill_sql("picked", "corpus")}
SELECT t.id, CAST(len(pos) AS INTEGER) AS n_pos, n_neg, m.neg AS neg FROM training t JOIN (
  SELECT f.id, count(*) AS n_neg, md5(string_agg(text, '|' ORDER BY place)) AS neg
  FROM filled f JOIN corpus USING (text_id) GROUP BY f.id) m USING (id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = mine_hard_negatives(training_rows(spark, sf_dir).drop("neg"))
    return mined.select(
        "id", F.size("pos").alias("n_pos"), F.size("neg").cast("long").alias("n_neg"),
        F.md5(F.array_join("neg", "|")).alias("neg"),
    )


@query(
    "mine_with_instructions",
    f"""WITH {TRAINING_SQL},
corpus AS (SELECT DISTINCT md5(text) AS text_id, text FROM (SELECT unnest(pos) AS text FROM training)),
asked AS (SELECT id AS tid, 'Find the law: ' || query AS text FROM training),
passages AS (SELECT text_id AS tid, 'law: ' || text AS text FROM corpus),
{hashing_sql("asked", "q")}, {hashing_sql("passages", "c")},
scored AS (
  SELECT q.tid AS id, c.tid AS text_id, round(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]), 10) AS score FROM q, c),
ranked AS (
  SELECT id, text_id, row_number() OVER (PARTITION BY id ORDER BY score DESC, text_id) AS rank FROM scored
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, text_id) <= 30),
known AS (
  SELECT id, md5(unnest(pos)) AS text_id FROM training UNION SELECT id, md5(query) FROM training),
picked AS (
  SELECT id, text_id FROM ranked ANTI JOIN known USING (id, text_id) WHERE rank > 2
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('42:neg:' || id || ':' || text_id), text_id) <= 15),
{_backfill_sql("picked", "corpus")}
SELECT id, place, text_id FROM filled""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir).drop("neg")
    corpus = table_roundtrip(negatives.distinct_texts(rows), new_path(spark, "corpus"))
    return mine_negative_ids(
        rows, corpus, lo=2, hi=30, query_instruction="Find the law:", query_format="{} {}",
        passage_instruction="law", passage_format="{}: {}",
    )


@query(
    "join_qrels",
    f"""WITH {QRELS_SQL}, {hits_sql(["reversed"])}
SELECT qid, docid, round(score, 6) AS score, coalesce(relevance, 0.0) AS relevance
FROM hits LEFT JOIN qrels USING (qid, docid)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = metrics.join_qrels(hits(spark, sf_dir, "reversed"), qrels(spark, sf_dir), "place")
    return joined.select("qid", "docid", F.round("score", 6).alias("score"), "relevance")


# All metrics at 10 and 50 over the hits and judgements of the queries in both.
METRICS_SQL = f"""
judged AS (SELECT h.*, coalesce(r.relevance, 0.0) AS rel,
                  row_number() OVER (PARTITION BY model, h.qid ORDER BY score DESC, h.docid DESC) AS r
           FROM hits h LEFT JOIN qrels r ON r.qid = h.qid AND r.docid = h.docid
           WHERE h.qid IN (SELECT qid FROM qrels)),
found AS (SELECT *, sum(CAST(rel > 0 AS INTEGER)) OVER (PARTITION BY model, qid ORDER BY r) / r AS p FROM judged),
ideal AS (
  SELECT qid, sum(CAST(relevance > 0 AS INTEGER)) AS total,
         sum(relevance / log2(i + 1)) FILTER (i <= 10) AS i10, sum(relevance / log2(i + 1)) FILTER (i <= 50) AS i50
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC) AS i FROM qrels) GROUP BY qid),
per_query AS (
  SELECT model, f.qid, any_value(total) AS total,
    {', '.join(f'''coalesce(sum(rel / log2(r + 1)) FILTER (r <= {k}), 0) / any_value(i{k}) AS ndcg{k},
    coalesce(sum(p) FILTER (r <= {k} AND rel > 0), 0) / any_value(total) AS map{k},
    count(*) FILTER (r <= {k} AND rel > 0) / any_value(total) AS recall{k},
    count(*) FILTER (r <= {k} AND rel > 0) / {k}.0 AS precision{k},
    coalesce(max(1.0 / r) FILTER (r <= {k} AND rel > 0), 0) AS mrr{k}''' for k in (10, 50))}
  FROM found f JOIN ideal USING (qid) GROUP BY model, f.qid)"""


def _means(names) -> str:
    return ", ".join(f"round(avg({m}{k}), 5) AS {m}_at_{k}" for m in names for k in (10, 50))


@query(
    "compare_models",
    f"WITH {QRELS_SQL}, {hits_sql(MODELS)}, {METRICS_SQL} SELECT model, {_means(metrics.METRICS)} FROM per_query GROUP BY model",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = reduce(DataFrame.unionByName, [hits(spark, sf_dir, model) for model in MODELS])
    return metrics.compare_models(runs, qrels(spark, sf_dir), order="place", unique=True)


def _metric(name: str) -> None:
    sql = f'WITH {QRELS_SQL}, {hits_sql(["reversed"])}, {METRICS_SQL} SELECT {_means([name])} FROM per_query'

    @query(f"metric_{name}", sql)
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        judged = metrics.unique_qrels(qrels(spark, sf_dir), "place")
        return getattr(metrics, f"metric_{name}")(hits(spark, sf_dir, "reversed"), judged)


for _name in metrics.METRICS:
    _metric(_name)


# Test set from labelled texts, search in it, and metrics: the whole evaluation flow.
@query(
    "evaluate_test_set",
    f"""WITH {TEST_SET_SQL},
asked AS (SELECT CAST(id AS VARCHAR) AS tid, text FROM laws WHERE label IN (SELECT label FROM drawn)),
passages AS (SELECT doc AS tid, fact AS text FROM numbered),
qrels AS (SELECT CAST(id AS VARCHAR) AS qid, doc AS docid, 1.0::DOUBLE AS relevance FROM numbered JOIN laws USING (label)),
{hashing_sql("asked", "q")}, {hashing_sql("passages", "c")},
scored AS (
  SELECT q.tid AS qid, c.tid AS docid, round(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]), 10) AS score FROM q, c),
hits AS (
  SELECT 'hashing' AS model, * FROM scored
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) <= 100),
{METRICS_SQL} SELECT model, {_means(metrics.METRICS)} FROM per_query GROUP BY model""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus, judged = build_test_set(decisions(spark, sf_dir), laws(spark, sf_dir), "src", 10)
    return evaluate({"hashing": None}, queries, corpus, judged)


# Two models over the same test set: one plain, one with an instruction before the queries only.
@query(
    "evaluate_two_encoders",
    f"""WITH {TEST_SET_SQL},
asked AS (SELECT CAST(id AS VARCHAR) AS tid, text FROM laws WHERE label IN (SELECT label FROM drawn)),
told AS (SELECT tid, 'of the and ' || text AS text FROM asked),
passages AS (SELECT doc AS tid, fact AS text FROM numbered),
qrels AS (SELECT CAST(id AS VARCHAR) AS qid, doc AS docid, 1.0::DOUBLE AS relevance FROM numbered JOIN laws USING (label)),
{hashing_sql("asked", "q")}, {hashing_sql("told", "t")}, {hashing_sql("passages", "c")},
scored AS (
  SELECT 'plain' AS model, q.tid AS qid, c.tid AS docid, round(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]), 10) AS score FROM q, c
  UNION ALL
  SELECT 'told', t.tid, c.tid, round(list_inner_product(t.vec::DOUBLE[], c.vec::DOUBLE[]), 10) FROM t, c),
hits AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, docid) <= 100),
{METRICS_SQL} SELECT model, {_means(metrics.METRICS)} FROM per_query GROUP BY model""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus, judged = build_test_set(decisions(spark, sf_dir), laws(spark, sf_dir), "src", 10)
    told = Model(query_instruction="of the and", query_format="{} {}")
    return evaluate({"plain": None, "told": told}, queries, corpus, judged)
