"""Queries over vector scores, pooling, attention and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.catalog.inputs import (
    SPECIAL, TERMS_SQL, TOKENS_SQL, own_pairs, pairs_sql, term_weights, token_vectors, vectors,
)
from gleaner.catalog.registry import query, table
from gleaner.functions.vectors import l2_normalize as normalized
from gleaner.operators import attention, losses, scores
from gleaner.session import new_path
from gleaner.sources.tables import table_roundtrip

TEMPERATURE = 0.02


def _r6(c: str | Column, name: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(name)


def _elements(df: DataFrame, vec: str, *keys: str) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("at", "x")).select(*keys, "at", _r6(F.col("x").cast("double"), "x"))


def _elements_sql(source: str, vec: str, keys: str) -> str:
    return f"""
SELECT {keys}, CAST(n - 1 AS INTEGER) AS at, round(x::DOUBLE, 6) + 0.0 AS x FROM (
  SELECT {keys}, unnest({vec}) AS x, generate_subscripts({vec}, 1) AS n FROM {source})"""


@query(
    "l2_normalize",
    f"""WITH n AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings),
m AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS norm FROM n),
o AS (SELECT vec_id, list_transform(v, lambda x: x / norm) AS v FROM m) {_elements_sql("o", "v", "vec_id")}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v")
    )
    return _elements(scaled.select("vec_id", normalized("v").alias("v")), "v", "vec_id")


@query("pool_cls", f"WITH {TOKENS_SQL}, f AS (SELECT doc_id, vec FROM tokens WHERE pos = 0) {_elements_sql('f', 'vec', 'doc_id')}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(attention.pool_cls(token_vectors(spark, sf_dir)), "vec", "doc_id")


_POOL_MEAN = """, e AS (
  SELECT doc_id, unnest(vec)::DOUBLE AS x, generate_subscripts(vec, 1) AS n FROM tokens WHERE pos % 4 <> 3)
SELECT doc_id, CAST(n - 1 AS INTEGER) AS at, round(avg(x), 6) + 0.0 AS x FROM e GROUP BY doc_id, n"""


@query("pool_mean", f"WITH {TOKENS_SQL} {_POOL_MEAN}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = token_vectors(spark, sf_dir).withColumn("mask", F.when(F.col("pos") % 4 == 3, 0).otherwise(1))
    return _elements(attention.pool_mean(masked, mask="mask"), "vec", "doc_id")


@query(
    "pool_last",
    f"""WITH {TOKENS_SQL}, f AS (
  SELECT doc_id, vec FROM tokens WHERE pos % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1)
{_elements_sql('f', 'vec', 'doc_id')}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = token_vectors(spark, sf_dir).withColumn("mask", F.when(F.col("pos") % 4 == 1, 0).otherwise(1))
    return _elements(attention.pool_last(masked, mask="mask"), "vec", "doc_id")


@query("lexical_weights", f"WITH {TERMS_SQL} SELECT doc_id, token, round(weight, 6) AS weight FROM lexical")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = scores.lexical_weights(term_weights(spark, sf_dir), SPECIAL)
    return weights.select("doc_id", "token", F.round("weight", 6).alias("weight"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return scores.score_dense(v, v, own_pairs(v, "id"), temperature=TEMPERATURE)


_DENSE_SQL = f"""{pairs_sql("pairs", "embeddings", "vec_id")},
dense AS (
  SELECT q_id, p_id, list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) / {TEMPERATURE} AS dense
  FROM pairs JOIN embeddings q ON q.vec_id = q_id JOIN embeddings p ON p.vec_id = p_id)"""


@query("score_dense", f"WITH {_DENSE_SQL} SELECT q_id, p_id, round(dense, 6) + 0.0 AS dense FROM dense")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("q_id", "p_id", _r6("dense", "dense"))


_LEXICAL_SQL = f"""{TERMS_SQL}, {pairs_sql("doc_pairs", "documents", "doc_id")},
lexical_scores AS (
  SELECT q_id, p_id, coalesce(sum(q.weight * p.weight), 0.0) / {TEMPERATURE} AS lexical
  FROM doc_pairs LEFT JOIN lexical q ON q.doc_id = q_id
  LEFT JOIN lexical p ON p.doc_id = p_id AND p.token = q.token GROUP BY q_id, p_id)"""


@query("score_lexical", f"WITH {_LEXICAL_SQL} SELECT q_id, p_id, round(lexical, 6) AS lexical FROM lexical_scores")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    pairs = own_pairs(docs, "doc_id").join(docs.withColumnRenamed("doc_id", "p_id"), "p_id", "left_semi")
    weights = scores.lexical_weights(term_weights(spark, sf_dir), SPECIAL)
    weights = table_roundtrip(weights, new_path(spark, "weights"))  # both sides of the score read it
    found = scores.score_lexical(weights, weights, pairs, temperature=TEMPERATURE)
    return found.select("q_id", "p_id", F.round("lexical", 6).alias("lexical"))


def _maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_vectors(spark, sf_dir)
    docs = tokens.select("doc_id").distinct()
    pairs = own_pairs(docs, "doc_id").join(docs.withColumnRenamed("doc_id", "p_id"), "p_id", "left_semi")
    return scores.score_maxsim(tokens, tokens, pairs, temperature=TEMPERATURE)


_MAXSIM_SQL = f"""{TOKENS_SQL}, {pairs_sql("tok_pairs", "tokens", "doc_id")},
best AS (
  SELECT q_id, p_id, q.pos, max(list_inner_product(q.vec::DOUBLE[], p.vec::DOUBLE[])) AS best
  FROM tok_pairs JOIN tokens q ON q.doc_id = q_id AND q.pos > 0 JOIN tokens p ON p.doc_id = p_id AND p.pos > 0
  GROUP BY q_id, p_id, q.pos),
maxsim AS (SELECT q_id, p_id, avg(best) / {TEMPERATURE} AS maxsim FROM best GROUP BY q_id, p_id)"""


@query("score_maxsim", f"WITH {_MAXSIM_SQL} SELECT q_id, p_id, round(maxsim, 6) + 0.0 AS maxsim FROM maxsim")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maxsim(spark, sf_dir).select("q_id", "p_id", _r6("maxsim", "maxsim"))


# Inside a batch (the rows of a label): products of every row with every row.
_BATCH_SQL = """
prod AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s,
         b.embedding AS e
  FROM embeddings a JOIN embeddings b ON a.label = b.label)"""

_CATEGORY_SQL = f"""{_BATCH_SQL},
weighted AS (SELECT i, j, e, exp(s) / sum(exp(s)) OVER (PARTITION BY j) AS w FROM prod),
cells AS (SELECT i, w * unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS n FROM weighted),
category AS (SELECT i AS id, n, sum(x) AS x FROM cells GROUP BY i, n)"""


@query("category_vectors", f"WITH {_CATEGORY_SQL} SELECT id, CAST(n - 1 AS INTEGER) AS at, round(x, 6) + 0.0 AS x FROM category")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attention.category_vectors(vectors(spark, sf_dir), "label")
    return _elements(found, "category", "id")


_ATTENTION_SQL = f"""{_BATCH_SQL},
weighted AS (SELECT i, j, e, exp(s / 8.0) / sum(exp(s / 8.0)) OVER (PARTITION BY i) AS w FROM prod),
cells AS (SELECT i, w * unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS n FROM weighted),
sums AS (SELECT i AS id, n, sum(x) AS x FROM cells GROUP BY i, n)"""


def _attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "label", *[F.col("vec").alias(c) for c in "qkv"])
    return attention.self_attention_vectors(v, "label")


@query("self_attention_vectors", f"WITH {_ATTENTION_SQL} SELECT id, CAST(n - 1 AS INTEGER) AS at, round(x, 6) + 0.0 AS x FROM sums")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_attended(spark, sf_dir), "attended", "id")


_ATTENDED_SQL = f"""{_ATTENTION_SQL},
attended AS (SELECT id, list(x ORDER BY n) AS a FROM sums GROUP BY id),
{pairs_sql("pairs", "embeddings", "vec_id")},
att AS (
  SELECT q_id, p_id, list_inner_product(a, p.embedding::DOUBLE[]) / {TEMPERATURE} AS attention
  FROM pairs JOIN attended q ON q.id = q_id JOIN embeddings p ON p.vec_id = p_id)"""


def _attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return scores.score_attention(_attended(spark, sf_dir), v, own_pairs(v, "id"), temperature=TEMPERATURE)


@query("score_attention", f"WITH {_ATTENDED_SQL} SELECT q_id, p_id, round(attention, 6) + 0.0 AS attention FROM att")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attention_scores(spark, sf_dir).select("q_id", "p_id", _r6("attention", "attention"))


# The scores of pairs of pseudo-documents: dense over their first vectors, lexical over label weights, maxsim
# over all, attention with the query's first vector attended over the first vectors of its batch (every fifth
# document), category with both sides' category vectors of the same batches.
_FIRST_SQL = f"""{_MAXSIM_SQL},
firsts AS (SELECT doc_id, doc_id % 5 AS batch, vec::DOUBLE[] AS vec FROM tokens WHERE pos = 0),
dense AS (
  SELECT q_id, p_id, list_inner_product(q.vec, p.vec) / {TEMPERATURE} AS dense
  FROM tok_pairs JOIN firsts q ON q.doc_id = q_id JOIN firsts p ON p.doc_id = p_id),
bags AS (
  SELECT DISTINCT vec_id // 10 AS doc_id, label AS token, CAST(label + 1 AS DOUBLE) / 10 AS weight FROM embeddings),
lex AS (
  SELECT q_id, p_id, coalesce(sum(q.weight * p.weight), 0.0) / {TEMPERATURE} AS lexical
  FROM tok_pairs LEFT JOIN bags q ON q.doc_id = q_id LEFT JOIN bags p ON p.doc_id = p_id AND p.token = q.token
  GROUP BY q_id, p_id),
fprod AS (
  SELECT a.doc_id AS i, b.doc_id AS j, list_inner_product(a.vec, b.vec) AS s, b.vec AS e
  FROM firsts a JOIN firsts b ON a.batch = b.batch),
fweighted AS (
  SELECT i, j, e, exp(s / 8.0) / sum(exp(s / 8.0)) OVER (PARTITION BY i) AS wa, exp(s) / sum(exp(s)) OVER (PARTITION BY j) AS wc
  FROM fprod),
fcells AS (SELECT i, wa, wc, unnest(e) AS x, generate_subscripts(e, 1) AS n FROM fweighted),
fsums AS (SELECT i, n, sum(wa * x) AS a, sum(wc * x) AS c FROM fcells GROUP BY i, n),
fvecs AS (SELECT i AS doc_id, list(a ORDER BY n) AS attended, list(c ORDER BY n) AS category FROM fsums GROUP BY i),
more AS (
  SELECT q_id, p_id, list_inner_product(q.attended, f.vec) / {TEMPERATURE} AS attention,
         list_inner_product(q.category, p.category) / {TEMPERATURE} AS category
  FROM tok_pairs JOIN fvecs q ON q.doc_id = q_id JOIN fvecs p ON p.doc_id = p_id JOIN firsts f ON f.doc_id = p_id),
ensemble AS (
  SELECT q_id, p_id, dense, lexical, maxsim, attention, category,
         dense + 0.3 * lexical + maxsim + 0.3 * attention AS ensemble
  FROM dense JOIN lex USING (q_id, p_id) JOIN maxsim USING (q_id, p_id) JOIN more USING (q_id, p_id))"""


def _firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, batch, vec, attended, category) of every pseudo-document, written: several scores read it."""
    firsts = token_vectors(spark, sf_dir).where("pos = 0").select(F.col("doc_id").alias("id"), "vec")
    firsts = firsts.withColumn("batch", F.col("id") % 5)
    heads = firsts.select("id", "batch", *[F.col("vec").alias(c) for c in "qkv"])
    attended = attention.self_attention_vectors(heads, "batch")
    category = attention.category_vectors(firsts, "batch")
    found = firsts.join(attended, ["batch", "id"]).join(category, ["batch", "id"])
    return table_roundtrip(found, new_path(spark, "firsts"))


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("doc_id"), F.col("label").cast("string").alias("token"),
        ((F.col("label") + 1) / 10.0).alias("weight"),
    )
    return scores.lexical_weights(raw)


def _all_scores(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The parts of the ensemble, and the category scores."""
    tokens, firsts, bags = token_vectors(spark, sf_dir), _firsts(spark, sf_dir), _bags(spark, sf_dir)
    docs = tokens.select("doc_id").distinct()
    pairs = own_pairs(docs, "doc_id").join(docs.withColumnRenamed("doc_id", "p_id"), "p_id", "left_semi")
    pairs = table_roundtrip(pairs, new_path(spark, "pairs"))
    category = scores.score_dense(firsts, firsts, pairs, vec="category", temperature=TEMPERATURE, name="category")
    return {
        "dense": scores.score_dense(firsts, firsts, pairs, temperature=TEMPERATURE),
        "lexical": scores.score_lexical(bags, bags, pairs, temperature=TEMPERATURE),
        "maxsim": scores.score_maxsim(tokens, tokens, pairs, temperature=TEMPERATURE),
        "attention": scores.score_attention(firsts, firsts, pairs, temperature=TEMPERATURE),
    }, category


@query("score_ensemble", f"WITH {_FIRST_SQL} SELECT q_id, p_id, round(ensemble, 6) + 0.0 AS ensemble FROM ensemble")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores.score_ensemble(**_all_scores(spark, sf_dir)[0])
    return found.select("q_id", "p_id", _r6("ensemble", "ensemble"))


@query(
    "teacher_softmax",
    """SELECT event_id, round(exp(value - m) / sum(exp(value - m)) OVER (PARTITION BY user_id), 6) AS target
FROM (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id) AS m FROM events)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    found = losses.teacher_softmax(events, "user_id", "value", "event_id")
    return found.select("event_id", F.round("target", 6).alias("target"))


@query(
    "contrastive_loss",
    f"""WITH {_DENSE_SQL},
shifted AS (SELECT q_id, p_id, dense, max(dense) OVER (PARTITION BY q_id) AS m FROM dense),
per_query AS (
  SELECT q_id, any_value(m) + ln(sum(exp(dense - m))) - max(dense) FILTER (p_id = q_id) AS loss FROM shifted GROUP BY q_id)
SELECT round(avg(loss), 6) AS loss FROM per_query""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _dense(spark, sf_dir).withColumn("is_target", F.col("q_id") == F.col("p_id"))
    return losses.contrastive_loss(scored, "q_id", "dense").select(F.round("loss", 6).alias("loss"))


def _in_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries, and for each a positive (its vector turned around by 32 elements) and a negative (reversed)."""
    v = vectors(spark, sf_dir)
    positive = F.concat(F.slice("vec", 33, 32), F.slice("vec", 1, 32))
    passages = v.select(
        "label", F.col("id").alias("group"),
        F.inline(
            F.array(
                F.struct((F.col("id") * 2).alias("id"), F.lit(True).alias("is_target"), positive.alias("vec")),
                F.struct((F.col("id") * 2 + 1).alias("id"), F.lit(False).alias("is_target"), F.reverse("vec").alias("vec")),
            )
        ),
    )
    return v, passages


@query(
    "in_batch_loss",
    f"""WITH passages AS (
  SELECT label, vec_id AS grp, true AS hit, list_concat(embedding[33:64], embedding[1:32]) AS vec FROM embeddings
  UNION ALL SELECT label, vec_id, false, list_reverse(embedding) FROM embeddings),
prod AS (
  SELECT a.vec_id AS i, p.grp = a.vec_id AND hit AS target,
         list_inner_product(a.embedding::DOUBLE[], p.vec::DOUBLE[]) / {TEMPERATURE} AS s
  FROM embeddings a JOIN passages p ON a.label = p.label),
per_query AS (
  SELECT i, any_value(m) + ln(sum(exp(s - m))) - max(s) FILTER (target) AS loss
  FROM (SELECT *, max(s) OVER (PARTITION BY i) AS m FROM prod) GROUP BY i)
SELECT round(avg(loss), 6) AS loss FROM per_query""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = _in_batch(spark, sf_dir)
    loss = losses.in_batch_loss(q, p, "label", temperature=TEMPERATURE)
    return loss.select(F.round("loss", 6).alias("loss"))


@query(
    "distill_loss",
    """WITH t AS (
  SELECT user_id, value / 10 AS s, max(value / 10) OVER (PARTITION BY user_id) AS m,
         exp((event_id % 7)) / sum(exp((event_id % 7))) OVER (PARTITION BY user_id) AS t FROM events),
g AS (SELECT user_id, sum(t) * (any_value(m) + ln(sum(exp(s - m)))) - sum(t * s) AS loss FROM t GROUP BY user_id)
SELECT round(avg(loss), 6) AS loss FROM g""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("value") / 10).alias("student"), (F.col("event_id") % 7).cast("double").alias("score")
    )
    taught = losses.teacher_softmax(events, "user_id", "score", "event_id")
    return losses.distill_loss(taught, "user_id").select(F.round("loss", 6).alias("loss"))


def _loss_sql(name: str) -> str:
    return f"""
{name}_loss AS (
  SELECT avg(loss) AS {name} FROM (
    SELECT any_value(m) + ln(sum(exp({name} - m))) - max({name}) FILTER (p_id = q_id) AS loss
    FROM (SELECT q_id, p_id, {name}, max({name}) OVER (PARTITION BY q_id) AS m FROM ensemble) GROUP BY q_id))"""


_LOSSES = ("dense", "lexical", "maxsim", "attention", "category", "ensemble")


@query(
    "blend_losses",
    f"""WITH {_FIRST_SQL}, {', '.join(_loss_sql(n) for n in _LOSSES)}
SELECT round((dense + ensemble + 0.1 * lexical + maxsim) / 4, 6) AS base,
       round((dense + ensemble + 0.1 * lexical + maxsim + 0.1 * attention) / 5, 6) AS attention,
       round((dense + ensemble + 0.1 * lexical + maxsim + category) / 5, 6) AS category,
       round(((dense + ensemble + 0.1 * lexical + maxsim + 0.1 * attention) / 5
              + (dense + 0.1 * lexical + maxsim + 0.1 * attention) / 4) / 2, 6) AS distilled
FROM {', '.join(f'{n}_loss' for n in _LOSSES)}""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, category = _all_scores(spark, sf_dir)
    joined = scores.score_ensemble(**parts).join(category, scores.PAIR)
    joined = joined.withColumn("is_target", F.col("q_id") == F.col("p_id"))
    # One row per part and group in one long table, so that all losses come out of one pass.
    stacked = joined.select(
        "q_id", "is_target", F.explode(F.create_map(*[x for n in _LOSSES for x in (F.lit(n), F.col(n))])).alias("part", "score")
    ).withColumn("group", F.struct("part", "q_id"))
    per_query = losses.query_losses(stacked, "group")
    row = per_query.groupBy().agg(*[F.avg(F.when(F.col("group.part") == n, F.col("loss"))).alias(n) for n in _LOSSES])
    for name in ("dense", "lexical", "maxsim", "attention"):
        row = row.withColumn(f"distill_{name}", F.col(name))
    row = losses.blend_losses(row, "base", out="o_base")
    row = losses.blend_losses(row, "attention", out="o_attention")
    row = losses.blend_losses(row, "category", out="o_category")
    row = losses.blend_losses(row, "attention", self_distill=True, out="o_distilled")
    return row.select(*[F.round(f"o_{n}", 6).alias(n) for n in ("base", "attention", "category", "distilled")])


# Batches of pseudo-documents: a query's positive is the document itself, turned around, all others are candidates.
@query(
    "in_batch_losses",
    f"""WITH {_FIRST_SQL},
cand AS (
  SELECT a.doc_id AS q_id, b.doc_id AS p_id,
         list_inner_product(a.vec, list_reverse(b.vec)) / {TEMPERATURE} AS dense,
         list_inner_product(v.attended, list_reverse(b.vec)) / {TEMPERATURE} AS attention
  FROM firsts a JOIN firsts b ON a.batch = b.batch JOIN fvecs v ON v.doc_id = a.doc_id),
cand_best AS (
  SELECT c.q_id, c.p_id, q.pos, max(list_inner_product(q.vec::DOUBLE[], p.vec::DOUBLE[])) AS best
  FROM cand c JOIN tokens q ON q.doc_id = c.q_id AND q.pos > 0 JOIN tokens p ON p.doc_id = c.p_id AND p.pos > 0
  GROUP BY c.q_id, c.p_id, q.pos),
cand_max AS (SELECT q_id, p_id, avg(best) / {TEMPERATURE} AS maxsim FROM cand_best GROUP BY q_id, p_id),
cand_lex AS (
  SELECT c.q_id, c.p_id, coalesce(sum(q.weight * p.weight), 0.0) / {TEMPERATURE} AS lexical
  FROM cand c LEFT JOIN bags q ON q.doc_id = c.q_id LEFT JOIN bags p ON p.doc_id = c.p_id AND p.token = q.token
  GROUP BY c.q_id, c.p_id),
scored AS (
  SELECT *, dense + 0.3 * lexical + maxsim + 0.3 * attention AS ensemble
  FROM cand JOIN cand_max USING (q_id, p_id) JOIN cand_lex USING (q_id, p_id)),
{', '.join(_loss_sql(n).replace("FROM ensemble)", "FROM scored)") for n in ("dense", "lexical", "maxsim", "attention", "ensemble"))}
SELECT round(dense, 6) AS dense, round(lexical, 6) AS lexical, round(maxsim, 6) AS maxsim, round(attention, 6) AS attention,
       round(ensemble, 6) AS ensemble
FROM dense_loss, lexical_loss, maxsim_loss, attention_loss, ensemble_loss""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = _firsts(spark, sf_dir)
    rest = token_vectors(spark, sf_dir).where("pos > 0").groupBy("doc_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda t: t["vec"])).alias("tokens")
    )
    bags = _bags(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("token", "weight")).alias("lexical"))
    docs = firsts.join(rest, firsts["id"] == rest["doc_id"]).drop("doc_id")
    docs = docs.join(bags, docs["id"] == bags["doc_id"]).withColumn("token_dim", F.lit(64))
    common = ["batch", "id", "tokens", "token_dim", "lexical"]
    q = docs.select(*common, F.col("vec").alias("dense"), F.col("attended").alias("attention"))
    turned = F.reverse("vec")
    p = docs.select(
        *common, turned.alias("dense"), turned.alias("attention"), F.col("id").alias("group"), F.lit(True).alias("is_target")
    )
    weights = {"dense": 1.0, "lexical": 0.3, "maxsim": 1.0, "attention": 0.3}
    found = losses.in_batch_losses(q, p, "batch", list(weights), weights, TEMPERATURE)
    return found.select(*[F.round(n, 6).alias(n) for n in found.columns])


@query("mean_eval_loss", "SELECT round(avg(value), 4) AS loss FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.mean_eval_loss(table(spark, sf_dir, "events").select(F.col("value").alias("loss")))
