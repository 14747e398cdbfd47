"""Inputs of the operators, derived from whole tables, each beside the SQL that derives the same."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.catalog.registry import table
from gleaner.operators.skew import spread

# Training rows: the first line of a document is its query, its lines are the positives and its
# sentences the negatives.
TRAINING_SQL = """
training AS (
  SELECT doc_id AS id, source AS title, string_split(text, chr(10))[1] AS query,
         string_split(text, chr(10)) AS pos, string_split(text, '. ') AS neg
  FROM documents)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, over all cores even where the file is one block: their texts are costly to work on."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("title"),
        F.split("text", "\n")[0].alias("query"),
        F.split("text", "\n").alias("pos"),
        F.split("text", r"\. ").alias("neg"),
    )


# Decisions: a text with packed labels. Some rows leave the family, some have a space after the comma.
DECISIONS_SQL = """
decisions AS (
  SELECT doc_id AS key, text AS fact,
         source || CASE doc_id % 4 WHEN 0 THEN ',src1' WHEN 1 THEN ', src1' WHEN 2 THEN ',' || lang ELSE '' END
         AS laws_service
  FROM documents)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (
        F.when(F.col("doc_id") % 4 == 0, ",src1")
        .when(F.col("doc_id") % 4 == 1, ", src1")
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit(","), "lang"))
        .otherwise("")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("text").alias("fact"), F.concat("source", more).alias("laws_service")
    )


# Laws: every document under its source's name, so titles repeat and the first id wins.
def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )


# Token vectors: ten consecutive vectors are the tokens of one pseudo-document.
TOKENS_SQL = """
tokens AS (
  SELECT vec_id // 10 AS doc_id, CAST(vec_id % 10 AS INTEGER) AS pos, embedding AS vec FROM embeddings)"""


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("doc_id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )


GROUP = 8  # passages per query


def own_pairs(ids: DataFrame, id_col: str) -> DataFrame:
    """Each id with itself (its positive) and the seven ids after it: one group per query."""
    offset = F.explode(F.sequence(F.lit(0), F.lit(GROUP - 1))).alias("offset")
    return ids.select(F.col(id_col).alias("q_id"), offset).select(
        "q_id", (F.col("q_id") + F.col("offset")).alias("p_id")
    )


def pairs_sql(name: str, source: str, id_col: str) -> str:
    return f"""
{name} AS (
  SELECT a.{id_col} AS q_id, b.{id_col} AS p_id
  FROM (SELECT DISTINCT {id_col} FROM {source}) a JOIN (SELECT DISTINCT {id_col} FROM {source}) b
    ON b.{id_col} BETWEEN a.{id_col} AND a.{id_col} + {GROUP - 1})"""


# Term weights: words of the documents. The weight falls with the place; short words get a negative one.
TERMS_SQL = """
words AS (
  SELECT doc_id, unnest(string_split(text, ' ')) AS token,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
terms AS (
  SELECT doc_id, token, pos, CAST(length(token) - 3 AS DOUBLE) / CAST(1 + pos AS DOUBLE) AS weight FROM words),
lexical AS (
  SELECT doc_id, token, max(greatest(weight, 0.0)) AS weight FROM terms
  WHERE token NOT IN ('the', 'le', 'die', 'el') GROUP BY doc_id, token)"""
SPECIAL = ("the", "le", "die", "el")


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Words are many times the size of the texts: dealt by document before they are parted, a document's words meet
    # in its own partition. The partitions are small, as each holds the words of all its documents.
    n = max(2 * spark.sparkContext.defaultParallelism, 8 * docs.rdd.getNumPartitions())
    words = docs.select("doc_id", "text").repartition(n, "doc_id").select(
        "doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")
    )
    weight = (F.char_length("token") - 3).cast("double") / (F.col("pos") + 1).cast("double")
    return words.withColumn("weight", weight)


# Judgements: a vector's own id, judged twice so that the later one counts, and the id after it.
QRELS_SQL = """
qrels AS (
  SELECT CAST(vec_id AS VARCHAR) AS qid, CAST(vec_id AS VARCHAR) AS docid, 1.0::DOUBLE AS relevance FROM embeddings
  UNION ALL
  SELECT CAST(vec_id AS VARCHAR), CAST(vec_id + 1 AS VARCHAR), 0.5::DOUBLE FROM embeddings)"""


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    qid = F.col("id").cast("string").alias("qid")
    ids = vectors(spark, sf_dir).select("id")

    def judged(docid, relevance: float, place: int) -> DataFrame:
        return ids.select(
            qid, docid.cast("string").alias("docid"), F.lit(relevance).alias("relevance"), F.lit(place).alias("place")
        )

    return (
        judged(F.col("id"), 0.25, 1).union(judged(F.col("id"), 1.0, 2)).union(judged(F.col("id") + 1, 0.5, 1))
    )


# Runs: three models that search with whole vectors, the passages' elements as they are, in reverse order, or
# with every second sign turned.
MODELS = {
    "plain": "{}",
    "reversed": "list_reverse({})",
    "flipped": "list_transform({}, lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END)",
}


def model_vector(model: str, vec: str) -> Column:
    if model == "reversed":
        return F.reverse(vec)
    if model == "flipped":
        return F.transform(vec, lambda x, i: F.when(i % 2 == 1, -x).otherwise(x))
    return F.col(vec)


def hits_sql(models: Iterable[str]) -> str:
    parts = [
        f"""SELECT '{name}' AS model, q.vec_id AS q, c.vec_id AS c,
         round(list_inner_product(q.embedding::DOUBLE[], {MODELS[name].format("c.embedding")}::DOUBLE[]), 10) AS score
  FROM embeddings q, embeddings c"""
        for name in models
    ]
    return f"""
scored AS ({' UNION ALL '.join(parts)}),
hits AS (
  SELECT model, CAST(q AS VARCHAR) AS qid, CAST(c AS VARCHAR) AS docid, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY model, q ORDER BY score DESC, c) <= 100)"""
