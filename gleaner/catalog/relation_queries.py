"""Queries over labels, lookups, samples, set operations and test sets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.catalog.inputs import DECISIONS_SQL, TRAINING_SQL, decisions, documents, laws, training_rows
from gleaner.catalog.registry import query, table
from gleaner.functions import text as tx
from gleaner.operators import labels, metrics, negatives, records, sampling
from gleaner.operators.embedding import Batches, embed_texts, hash_words
from gleaner.plans.testset import build_test_set


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_FAMILY_SQL = f"""{DECISIONS_SQL},
family AS (
  SELECT *, string_split(laws_service, ',')[1] AS label FROM decisions
  WHERE len(list_filter(string_split(laws_service, ','), lambda l: NOT starts_with(l, 'src'))) = 0)"""


@query("only_family", f"WITH {_FAMILY_SQL} SELECT key, laws_service FROM family")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where(tx.only_family("laws_service", "src")).select("key", "laws_service")


@query("first_label", f"WITH {DECISIONS_SQL} SELECT key, string_split(laws_service, ',')[1] AS label FROM decisions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("key", tx.first_label("laws_service").alias("label"))


@query(
    "count_labels_multi",
    f"""WITH {DECISIONS_SQL}
SELECT label, count(*) AS count FROM (SELECT unnest(string_split(laws_service, ',')) AS label FROM decisions) GROUP BY label""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.count_labels_multi(decisions(spark, sf_dir), "laws_service")


@query(
    "count_labels_single",
    f"""WITH {DECISIONS_SQL}
SELECT string_split(laws_service, ',')[1] AS label, count(*) AS count FROM decisions GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.count_labels_single(decisions(spark, sf_dir), "laws_service")


@query(
    "count_at_least",
    f"""WITH {_FAMILY_SQL} SELECT label, count(*) AS count FROM family GROUP BY label HAVING count(*) >= 25""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = decisions(spark, sf_dir).where(tx.only_family("laws_service", "src"))
    return labels.count_at_least(labels.count_labels_single(kept, "laws_service"), 25)


@query(
    "collect_by_class",
    """SELECT doc_id, lang, text FROM documents
WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 120)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "lang", "text")
    return labels.collect_by_class(docs, "lang", 120, ["doc_id"]).select("doc_id", "lang", "text")


@query(
    "top_labels",
    "SELECT user_id AS label, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, label LIMIT 20",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("label")).count()
    return labels.top_labels(counts)


_LAWS_SQL = """
laws AS (
  SELECT source AS label, min(doc_id) AS id, arg_min(text, doc_id) AS text FROM documents GROUP BY source)"""


@query("lookup_required", f"WITH {_LAWS_SQL} SELECT doc_id, label, id, l.text FROM documents d JOIN laws l ON d.source = l.label")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _documents(spark, sf_dir).select("doc_id", F.col("source").alias("label"))
    found = labels.lookup_required(asked, laws(spark, sf_dir), spread=["doc_id"])
    return found.select("doc_id", "label", "id", "text")


_TRAIN_TITLES = "SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1"


@query(
    "label_difference",
    f"SELECT DISTINCT source AS label FROM documents WHERE source NOT IN ({_TRAIN_TITLES})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_and_train(spark, sf_dir)
    return labels.label_difference(test, train)


@query(
    "missing_labels",
    f"SELECT source AS label, doc_id AS id, text AS content FROM documents WHERE source NOT IN ({_TRAIN_TITLES})",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = _test_and_train(spark, sf_dir)
    return labels.missing_labels(test, train, laws(spark, sf_dir)).select("label", "id", "content")


def _test_and_train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    label = F.col("source").alias("label")
    docs, judged = _documents(spark, sf_dir), table(spark, sf_dir, "labels")
    return docs.select(label), docs.join(judged.where("toxic = 1"), "doc_id", "left_semi").select(label)


@query(
    "sample_k_per_class",
    """SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('613:sample:' || doc_id), doc_id) <= 10""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source")
    return sampling.sample_k_per_class(docs, "source", "doc_id", 10, 613)


@query(
    "cap_rows",
    """SELECT event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42:cap:' || event_id), event_id) <= 1500""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.cap_rows(events, "event_type", "event_id", 1500)


TEST_SET_SQL = f"""{_FAMILY_SQL},
{_LAWS_SQL},
drawn AS (
  SELECT key, fact, label FROM family
  WHERE label IN (SELECT label FROM family GROUP BY label HAVING count(*) >= 10)
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('613:sample:' || key), key) <= 10),
numbered AS (
  SELECT *, CAST(row_number() OVER (ORDER BY label, md5('613:corpus:' || key), key) - 1 AS VARCHAR) AS doc FROM drawn)"""


@query(
    "build_test_set",
    f"""WITH {TEST_SET_SQL}
SELECT 'query' AS kind, CAST(id AS VARCHAR) AS id, text, '' AS docid, 0 AS relevance FROM laws
WHERE label IN (SELECT label FROM drawn)
UNION ALL SELECT 'corpus', doc, fact, '', 0 FROM numbered
UNION ALL SELECT 'qrel', CAST(id AS VARCHAR), '', doc, 1 FROM numbered JOIN laws USING (label)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus, qrels = build_test_set(decisions(spark, sf_dir), laws(spark, sf_dir), "src", 10)
    none, zero = F.lit(""), F.lit(0)
    return (
        queries.select(F.lit("query").alias("kind"), "id", "text", none.alias("docid"), zero.alias("relevance"))
        .union(corpus.select(F.lit("corpus"), "id", F.col("text")[0], none, zero))
        .union(qrels.select(F.lit("qrel"), "qid", none, "docid", "relevance"))
    )


@query(
    "distinct_texts",
    f"""WITH {TRAINING_SQL}
SELECT DISTINCT md5(text) AS text_id, text FROM (SELECT unnest(list_concat(pos, neg)) AS text FROM training)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.distinct_texts(training_rows(spark, sf_dir))


@query(
    "qrels_map",
    """SELECT CAST(user_id AS VARCHAR) AS qid, 0 AS part, count(*) AS n, string_agg(docid || '=' || relevance, ',' ORDER BY docid) AS judgements
FROM (SELECT user_id, CAST(event_id % 97 AS VARCHAR) AS docid, arg_max(CAST(event_id % 2 AS INTEGER), event_id) AS relevance
      FROM events GROUP BY user_id, event_id % 97) GROUP BY user_id""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("qid"),
        (F.col("event_id") % 97).cast("string").alias("docid"),
        (F.col("event_id") % 2).alias("relevance"),
        F.col("event_id").alias("place"),
    )
    maps = metrics.qrels_map(qrels, "place")
    shown = F.transform(
        F.array_sort(F.map_entries("judgements")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string")),
    )
    return maps.select(
        "qid", "part", F.size("judgements").cast("long").alias("n"), F.array_join(shown, ",").alias("judgements")
    )


# Signed hashing of words, the default encoder: one row per (text_id, element).
def hashing_sql(texts: str, name: str, dim: int = 64) -> str:
    return f"""
{name}_words AS (
  SELECT tid, md5(w) AS h FROM (SELECT tid, unnest(string_split_regex(text, '[\\t-\\r ]+')) AS w FROM {texts}) WHERE w <> ''),
{name}_counts AS (
  SELECT tid, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS slot,
         sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN -1.0 ELSE 1.0 END) AS n
  FROM {name}_words GROUP BY 1, 2),
{name}_norms AS (SELECT tid, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY tid),
{name}_cells AS (
  SELECT t.tid, r.slot, CAST(coalesce(c.n, 0.0) / greatest(coalesce(m.norm, 0.0), 1e-12) AS FLOAT) AS x
  FROM {texts} t CROSS JOIN (SELECT unnest(range({dim})) AS slot) r
  LEFT JOIN {name}_counts c ON c.tid = t.tid AND c.slot = r.slot LEFT JOIN {name}_norms m ON m.tid = t.tid),
{name} AS (SELECT tid, list(x ORDER BY slot) AS vec FROM {name}_cells GROUP BY tid)"""


@query(
    "embed_texts",
    f"""WITH texts AS (SELECT doc_id AS tid, 'fact: ' || text AS text FROM documents), {hashing_sql("texts", "v")}
SELECT tid AS doc_id, CAST(slot AS INTEGER) AS slot, round(x::DOUBLE, 6) + 0.0 AS x FROM v_cells""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    vectors = embed_texts(docs, "text", instruction="fact:", instruction_format="{} {}", key="doc_id")
    cells = vectors.select("doc_id", F.posexplode("vec").alias("slot", "x"))
    return cells.select("doc_id", "slot", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


# The first words of every text: those that a maximum length leaves, the instruction included.
@query(
    "embed_first_words",
    f"""WITH texts AS (
  SELECT doc_id AS tid, array_to_string(list_slice(list_filter(string_split_regex('fact: ' || text, '[\\t-\\r ]+'), lambda w: w <> ''), 1, 12), ' ') AS text
  FROM documents), {hashing_sql("texts", "v")}
SELECT tid AS doc_id, CAST(slot AS INTEGER) AS slot, round(x::DOUBLE, 6) + 0.0 AS x FROM v_cells""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    batches = Batches(rows=64, padded=600, held=500)
    vectors = embed_texts(
        docs, "text", lambda: lambda texts: hash_words(pa.array(texts, pa.string()), 64), instruction="fact:",
        instruction_format="{} {}", key="doc_id", max_length=12, batches=batches,
    )
    cells = vectors.select("doc_id", F.posexplode("vec").alias("slot", "x"))
    return cells.select("doc_id", "slot", (F.round(F.col("x").cast("double"), 6) + 0.0).alias("x"))


@query(
    "compare_embeddings",
    """SELECT vec_id AS id, round(list_max(list_transform(list_zip(embedding, cast(embedding AS DOUBLE[])),
         lambda p: CASE WHEN vec_id % 2 = 0 THEN 0.0 ELSE abs(p[1]::DOUBLE * 0.5) END)), 6) AS max_diff,
       vec_id % 2 = 0 AS equal
FROM embeddings""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    scale = F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5)
    b = a.select("id", F.transform("vec", lambda x: x.cast("double") * scale).alias("vec"))
    return records.compare_embeddings(a, b).withColumn("max_diff", F.round("max_diff", 6))
