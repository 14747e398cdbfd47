"""Queries over sources, row-wise work and ordering."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.catalog.inputs import TRAINING_SQL, documents, training_rows
from gleaner.catalog.registry import query, table
from gleaner.functions import text as tx
from gleaner.operators import hierarchy, ordering, records, training
from gleaner.plans.loading import load_training_rows
from gleaner.session import new_path
from gleaner.sources import tables as src

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@query("read_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    table(spark, sf_dir, "documents").write.json(path)
    return src.read_jsonl(spark, path, DOCUMENTS)


@query(
    "read_training_dirs",
    f"""WITH {TRAINING_SQL}
SELECT id, title, query, CAST(len(pos) AS INTEGER) AS n_pos, CAST(len(neg) AS INTEGER) AS n_neg FROM training
UNION ALL SELECT item_id, NULL, text, NULL, NULL FROM benchmark""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "training")
    benchmark = table(spark, sf_dir, "benchmark")
    training_rows(spark, sf_dir).write.json(f"{root}/a")
    benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("query")).write.json(f"{root}/b")
    benchmark.select("text").write.text(f"{root}/c")  # .txt files: passed over
    read = src.read_training_dirs(spark, [f"{root}/a", f"{root}/b", f"{root}/c"])
    n_pos, n_neg = (F.when(F.col(c).isNotNull(), F.size(c)).alias(f"n_{c}") for c in ("pos", "neg"))
    return read.select("id", "title", "query", n_pos, n_neg)


def _scored(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("pos_scores", F.transform("pos", lambda t, i: (i + 1).cast("double")))
    return rows.withColumn("neg_scores", F.transform("neg", lambda t, i: i / F.lit(2.0)))


@query(
    "score_columns_policy",
    f"""WITH {TRAINING_SQL}
SELECT id, query, CAST(len(pos) AS INTEGER) AS n_pos, CAST(len(neg) AS INTEGER) AS n_neg,
       CAST(len(pos) * (len(pos) + 1) // 2 AS DOUBLE) AS pos_total FROM training""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scored")
    _scored(training_rows(spark, sf_dir)).write.json(path)
    read = src.score_columns_policy(src.read_training_dirs(spark, [path]), distill=True, file_col="file")
    total = F.aggregate("pos_scores", F.lit(0.0), lambda a, x: a + x).alias("pos_total")
    return read.select("id", "query", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"), total)


@query(
    "load_training_rows",
    f"""WITH {TRAINING_SQL}
SELECT id, title, query, CAST(len(pos) AS INTEGER) AS n_pos, CAST(len(neg) AS INTEGER) AS n_neg FROM training
UNION ALL SELECT item_id, NULL, text, 1, 1 FROM benchmark""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "loaded")
    # One folder with scores, one without; none of the files is over the cap.
    _scored(training_rows(spark, sf_dir)).write.json(f"{root}/a")
    text = F.array("text")
    plain = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("query"), text.alias("pos"), text.alias("neg")
    )
    plain.write.json(f"{root}/b")
    rows = load_training_rows(spark, [f"{root}/a", f"{root}/b"])
    return rows.select("id", "title", "query", F.size("pos").alias("n_pos"), F.size("neg").alias("n_neg"))


@query("candidate_pool", "SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = [table(spark, sf_dir, name).select("text") for name in ("benchmark", "documents")]
    return src.candidate_pool(records.union_datasets(*pools))


@query("write_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ordered")
    src.write_jsonl(table(spark, sf_dir, "conversations"), path, ["conv_id", "turn"])
    return src.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("table_roundtrip", "SELECT * FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table_roundtrip(table(spark, sf_dir, "lineitem"), new_path(spark, "table"))


# The Unicode white space and digits the patterns mean, spelled out for RE2.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _strip_sql(sql: str) -> str:
    ws = r"\x1c-\x1f" + _WS
    return f"regexp_replace(regexp_replace({sql}, '^[{ws}]+', ''), '[{ws}]+$', '')"


def _clean_sql(column: str) -> str:
    sql = _strip_sql(column)
    for pattern in tx.CLEAN_PATTERNS:
        pattern = pattern.replace(r"\s", f"[{_WS}]").replace(r"\d", r"\p{Nd}")
        sql = f"regexp_replace({sql}, '{pattern}', '', 'g')"
    return _strip_sql(sql)


_RAW_SQL = """
raw AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '① ' || text
    WHEN 1 THEN '9. ' || text || ' <개정 2020. 1. 2., 2021.3.4>'
    WHEN 2 THEN chr(160) || text || ' <신설 1995.12.29>'
    WHEN 3 THEN chr(12288) || text || '<2016. 1. 6.>'
    WHEN 4 THEN '10. 「' || text || '」, ' || chr(160)
    ELSE text || '. ' END AS raw
  FROM documents)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, text = F.col("doc_id") % 6, F.col("text")
    raw = (
        F.when(case == 0, F.concat(F.lit("① "), text))
        .when(case == 1, F.concat(F.lit("9. "), text, F.lit(" <개정 2020. 1. 2., 2021.3.4>")))
        .when(case == 2, F.concat(F.lit(" "), text, F.lit(" <신설 1995.12.29>")))
        .when(case == 3, F.concat(F.lit("　"), text, F.lit("<2016. 1. 6.>")))
        .when(case == 4, F.concat(F.lit("10. 「"), text, F.lit("」,  ")))
        .otherwise(F.concat(text, F.lit(". ")))
    )
    return documents(spark, sf_dir).select("doc_id", raw.alias("raw"))


@query("clean_text", f"WITH {_RAW_SQL} SELECT doc_id, {_clean_sql('raw')} AS clean FROM raw")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("doc_id", tx.clean_text("raw").alias("clean"))


# Every document becomes a nested statute article: its lines are clauses or bare items, the sentences
# of a line are its items. Every 20th is a heading, in turn of a part and of a chapter.
def _statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    id = F.col("doc_id")
    number = F.floor(id / 40) + 1
    heading = F.when(
        id % 20 == 0,
        F.when(id % 40 == 0, F.concat(F.lit("제"), number, F.lit("편 총칙")))
        .otherwise(F.concat(F.lit("제"), number, F.lit("장 형"))),
    )
    key = F.concat(id.cast("string"), F.when(id % 20 == 0, "0").otherwise("1"))
    branch = F.when(id % 7 == 0, "2")
    base = [
        id.cast("string").alias(hierarchy.NUMBER),
        branch.alias(hierarchy.BRANCH),
        key.alias(hierarchy.KEY),
        F.coalesce(heading, F.when(id % 3 == 2, F.col("text")).otherwise(lines[0])).alias(hierarchy.CONTENT),
    ]

    def items(texts):
        return F.transform(texts, lambda t: F.struct(t.alias(hierarchy.ITEM_TEXT)))

    def clause(line):
        sentences = F.split(line, r"\. ")
        return F.struct(
            line.alias(hierarchy.CLAUSE_TEXT),
            F.when(F.size(sentences) > 1, items(sentences)).alias(hierarchy.ITEMS),
        )

    listed = F.to_json(F.struct(*base, F.transform(lines, clause).alias(hierarchy.CLAUSES)))
    bare = F.to_json(F.struct(*base, F.struct(items(lines).alias(hierarchy.ITEMS)).alias(hierarchy.CLAUSES)))
    doc = F.when(id % 3 == 0, listed).when(id % 3 == 1, bare).otherwise(F.to_json(F.struct(*base)))
    return documents(spark, sf_dir).select(F.col("source").alias("law_id"), id.alias("seq"), doc.alias("doc"))


_STATUTE_SQL = f"""
statutes AS (
  SELECT source AS law_id, doc_id AS seq, CAST(doc_id % 20 = 0 AS INTEGER) AS preamble,
         CASE WHEN doc_id % 40 = 0 THEN '제' || (doc_id // 40 + 1) || '편 총칙'
              WHEN doc_id % 20 = 0 THEN '제' || (doc_id // 40 + 1) || '장 형'
              WHEN doc_id % 3 = 2 THEN text ELSE string_split(text, chr(10))[1] END AS own,
         CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS article_branch,
         string_split(text, chr(10)) AS lines
  FROM documents),
clauses AS (
  SELECT law_id, seq, article_branch, unnest(lines) AS line, generate_subscripts(lines, 1) AS n
  FROM statutes WHERE preamble = 0 AND seq % 3 <> 2),
items AS (
  SELECT law_id, seq, article_branch, n, unnest(string_split(line, '. ')) AS item,
         generate_subscripts(string_split(line, '. '), 1) AS m
  FROM clauses WHERE seq % 3 = 0 AND len(string_split(line, '. ')) > 1),
flat AS (
  SELECT law_id, seq, preamble, article_branch, 0 AS paragraph, 0 AS subparagraph, own AS raw FROM statutes
  UNION ALL SELECT law_id, seq, 0, article_branch, n, 0, line FROM clauses WHERE seq % 3 = 0
  UNION ALL SELECT law_id, seq, 0, article_branch, n, m, item FROM items
  UNION ALL SELECT law_id, seq, 0, article_branch, 0, n, line FROM clauses WHERE seq % 3 = 1),
clause_rows AS (
  SELECT law_id, seq, preamble, CAST(seq AS INTEGER) AS article, article_branch, CAST(paragraph AS INTEGER) AS paragraph,
         CAST(subparagraph AS INTEGER) AS subparagraph, {_clean_sql('raw')} AS content FROM flat)"""


@query("flatten_hierarchy", f"WITH {_STATUTE_SQL} SELECT * FROM clause_rows")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.flatten_hierarchy(_statutes(spark, sf_dir), "law_id", "seq")


_CARRIED_SQL = f"""{_STATUTE_SQL},
marks AS (
  SELECT law_id, seq,
         CASE WHEN seq % 40 = 0 THEN CAST(seq // 40 + 1 AS INTEGER) END AS part_mark,
         CASE WHEN seq % 40 = 0 THEN 0 WHEN seq % 20 = 0 THEN CAST(seq // 40 + 1 AS INTEGER) END AS chapter_mark
  FROM statutes),
carried AS (
  SELECT law_id, seq,
         coalesce(last_value(part_mark IGNORE NULLS) OVER w, 0) AS part,
         coalesce(last_value(chapter_mark IGNORE NULLS) OVER w, 0) AS chapter
  FROM marks WINDOW w AS (PARTITION BY law_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "clause_table",
    f"""WITH {_CARRIED_SQL}
SELECT c.*, part, chapter FROM clause_rows c JOIN carried USING (law_id, seq)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.clause_table(_statutes(spark, sf_dir), "law_id", "seq")


@query(
    "statute_query_table",
    f"""WITH {_STATUTE_SQL}
SELECT row_number() OVER (ORDER BY law_id, seq, paragraph, subparagraph) - 1 AS id,
       '형법 제' || article || '조' || CASE WHEN article_branch = 1 THEN '' ELSE '의' || article_branch END
       || CASE WHEN paragraph = 0 THEN '' ELSE ' 제' || paragraph || '항' END
       || CASE WHEN subparagraph = 0 THEN '' ELSE ' 제' || subparagraph || '호' END AS title, content
FROM clause_rows WHERE preamble = 0 AND NOT content LIKE '%삭제'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = hierarchy.flatten_hierarchy(_statutes(spark, sf_dir), "law_id", "seq")
    return hierarchy.query_table(clauses, "형법", "law_id", "seq")


@query(
    "preamble_flag",
    """SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber % 2 AS VARCHAR) LIKE '%0' AS INTEGER) AS preamble
FROM lineitem""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("l_orderkey").cast("string"), (F.col("l_linenumber") % 2).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.preamble_flag(key).alias("preamble"))


@query("drop_headings", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("preamble")
    return hierarchy.drop_headings(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", flag))


@query(
    "drop_deleted",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '삭제 ' || text ELSE text END AS content
FROM documents WHERE doc_id % 5 <> 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("삭제 "), text))
        .when(F.col("doc_id") % 5 == 1, F.concat(text, F.lit(" 삭제　")))
        .otherwise(text)
    )
    return hierarchy.drop_deleted(table(spark, sf_dir, "documents").select("doc_id", content.alias("content")))


@query(
    "compose_title",
    """SELECT l_orderkey, l_linenumber,
       '형법 제' || l_orderkey || '조' || CASE WHEN l_linenumber = 1 THEN '' ELSE '의' || l_linenumber END
       || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE ' 제' || (l_suppkey % 3) || '항' END
       || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE ' 제' || (l_partkey % 4) || '호' END AS title
FROM lineitem""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = tx.compose_title(
        "형법", "l_orderkey", "l_linenumber", F.col("l_suppkey") % 3, F.col("l_partkey") % 4
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", title.alias("title"))


# Files of three kinds: with scores, with scores that are all null, without the columns.
@query(
    "file_columns",
    """SELECT doc_id AS id, doc_id % 3 < 2 AS pos_scores, doc_id % 3 < 2 AS neg_scores,
       CASE WHEN doc_id % 3 = 0 THEN CAST(len(string_split(text, chr(10))) AS INTEGER) END AS n_scores
FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "kinds")
    rows = _scored(training_rows(spark, sf_dir)).withColumn("kind", F.col("id") % 3)
    nothing = F.lit(None).cast("array<double>")
    for kind, part in enumerate((rows, rows.withColumns({"pos_scores": nothing, "neg_scores": nothing}), rows.drop("pos_scores", "neg_scores"))):
        part.where(F.col("kind") == kind).write.option("ignoreNullFields", "false").json(f"{root}/{kind}")
    folders = [f"{root}/{kind}" for kind in range(3)]
    n_scores = F.when(F.col("pos_scores").isNotNull(), F.size("pos_scores")).alias("n_scores")
    read = src.read_training_dirs(spark, folders).select("id", "file", n_scores)
    # One row for each file: no bound is known, so the join picks its own way.
    return read.join(src.file_columns(spark, folders), "file").select("id", "pos_scores", "neg_scores", "n_scores")


@query(
    "respace_title",
    """SELECT doc_id AS id, '형법 제' || doc_id || '조의2 제3항 제' || n_chars || '호' AS title, text AS content
FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("제"), F.col("doc_id"), F.lit("조의2제3항제"), F.col("n_chars"), F.lit("호"))
    old = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.struct(title.alias("title"), F.col("text").alias("content")).alias("query")
    )
    return records.lift_query(old, "형법")


@query(
    "map_rows",
    "SELECT conv_id, turn, upper(role) AS role, CAST(length(text) AS INTEGER) AS n FROM conversations",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.map_rows(
        table(spark, sf_dir, "conversations"), {"role": F.upper("role"), "n": F.char_length("text")}, ["text"]
    )


def _make_word_stats():
    """A batch function: the words of each text, its longest word in bytes and its first one."""

    def stats(batch: pa.RecordBatch) -> dict:
        words = [t.encode().split() for t in pc.fill_null(batch.column("text"), "").to_pylist()]
        return {
            "n_words": np.array([len(w) for w in words]), "longest": [max(map(len, w), default=0) for w in words],
            "first": pa.array([w[0].decode() if w else None for w in words], pa.string()),
        }

    return stats


@query(
    "map_batches",
    """WITH split AS (
  SELECT *, list_filter(string_split_regex(text, '[\\t-\\r ]+'), lambda w: w <> '') AS words FROM documents)
SELECT doc_id, lang, source, CAST(len(words) AS INTEGER) AS n_words,
       CAST(coalesce(list_max(list_transform(words, lambda w: strlen(w))), 0) AS INTEGER) AS longest, words[1] AS first
FROM split""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return records.map_batches(
        docs, _make_word_stats, "n_words int, longest int, first string", ["text", "n_chars"], ["text"], batch_rows=200
    )


@query(
    "dense_ids",
    """SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS id, event_id, user_id
FROM events WHERE event_type <> 'error'""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id", "user_id", "ts")
    return ordering.dense_ids(kept, ["user_id", "ts", "event_id"]).select("id", "event_id", "user_id")


@query("sort_by_id", "SELECT event_id AS id, value FROM events ORDER BY id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sort_by_id(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value"))


@query("head_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 16")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.head_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query(
    "carry_headings",
    """SELECT user_id, event_id, coalesce(last_value(p IGNORE NULLS) OVER w, 0) AS part,
       coalesce(last_value(c IGNORE NULLS) OVER w, 0) AS chapter
FROM (SELECT user_id, event_id,
             CASE WHEN event_type = 'signup' THEN CAST(floor(value) AS INTEGER) END AS p,
             CASE WHEN event_type = 'signup' THEN 0
                  WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) END AS c FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor("value").cast("int")
    marked = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") == "signup", number).alias("part"),
        F.when(F.col("event_type") == "purchase", number).alias("chapter"),
    )
    return ordering.carry_headings(marked, "user_id", "event_id", content=None)


@query(
    "epoch_batches",
    """WITH placed AS (
  SELECT event_id, row_number() OVER (ORDER BY md5('42:epoch1:' || event_id), event_id) - 1 AS place FROM events)
SELECT event_id, place, place // 32 AS batch FROM placed
WHERE place // 32 < (SELECT count(*) // 32 FROM events)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return ordering.epoch_batches(events, "event_id", 32, epoch=1, drop_last=True)


@query(
    "rank_batches",
    """WITH placed AS (
  SELECT event_id, row_number() OVER (ORDER BY md5('42:epoch2:' || event_id), event_id) - 1 AS place,
         count(*) OVER () AS n FROM events),
slots AS (
  SELECT event_id, place, unnest(generate_series(place, (n + 383) // 384 * 384 - 1, n)) AS slot FROM placed)
SELECT event_id, slot, slot // 64 AS batch, CAST(slot // 64 % 6 AS INTEGER) AS rank, slot // 384 AS step, slot > place AS padded
FROM slots WHERE slot // 384 >= 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id")
    return ordering.rank_batches(events, "event_id", 64, 6, epoch=2, first_step=1)


_TEMPLATE = "Write #K# sentences that fit the rule. Give exactly #K# of them."


@query(
    "render_prompts",
    f"""SELECT doc_id AS id, replace('{_TEMPLATE}', '#K#', '20') AS instructions,
       '"id" : ' || doc_id || ', "title" : ' || source || ', "query" : "' || text || '"' AS prompt FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content")
    )
    return records.render_prompts(docs, _TEMPLATE, 20)


@query(
    "merge_generated",
    """SELECT event_id AS id, event_type AS title,
       CASE WHEN event_id % 4 = 1 THEN 'q' || user_id ELSE props END AS query,
       CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS n_pos,
       CASE WHEN event_id % 4 = 1 THEN props ELSE '' END AS first_pos
FROM events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, id = table(spark, sf_dir, "events"), F.col("event_id")
    queries = events.select(id.alias("id"), F.col("event_type").alias("title"), F.col("props").alias("content"))
    good = F.to_json(
        F.struct(
            id.alias("id"), F.col("event_type").alias("title"), F.concat(F.lit("q"), "user_id").alias("query"),
            F.array("props", "event_type").alias("pos"),
        )
    )
    # One in four is fine, one in four is cut short, one in four is empty, one in four never came.
    response = F.when(id % 4 == 1, good).when(id % 4 == 2, F.substring(good, 1, 20))
    responses = events.where(id % 4 != 0).select(id.alias("request_id"), response.alias("response"))
    merged = records.merge_generated(queries, responses)
    return merged.select(
        "id", "title", "query", F.size("pos").alias("n_pos"), F.coalesce(F.get("pos", F.lit(0)), F.lit("")).alias("first_pos")
    )


@query(
    "split_positives",
    f"""WITH {TRAINING_SQL}
SELECT id, 'train' AS part, CAST(len(pos[1:10]) AS INTEGER) AS n, array_to_string(pos[1:10], '|') AS pos FROM training
UNION ALL SELECT id, 'heldout', CAST(len(pos[11:]) AS INTEGER), array_to_string(pos[11:], '|') FROM training""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = zip(("train", "heldout"), records.split_positives(training_rows(spark, sf_dir)))
    shown = [
        df.select("id", F.lit(name).alias("part"), F.size("pos").alias("n"), F.array_join("pos", "|").alias("pos"))
        for name, df in copies
    ]
    return records.union_datasets(*shown)


@query(
    "check_list_sizes",
    f"""WITH {TRAINING_SQL}
SELECT id, CAST(len(pos) AS INTEGER) AS size, CAST((SELECT len(pos) FROM training ORDER BY id LIMIT 1) AS INTEGER) AS expected
FROM training WHERE len(pos) <> (SELECT len(pos) FROM training ORDER BY id LIMIT 1)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.check_list_sizes(training_rows(spark, sf_dir), "pos").select("id", "size", "expected")


@query(
    "to_retrieval_tables",
    f"""WITH {TRAINING_SQL}
SELECT CAST(id AS VARCHAR) AS qid, CAST(id AS VARCHAR) AS docid, 1 AS relevance, query, CAST(len(pos) AS INTEGER) AS n_texts
FROM training""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus, qrels = records.to_retrieval_tables(training_rows(spark, sf_dir))
    q = queries.select(F.col("id").alias("qid"), F.col("text").alias("query"))
    c = corpus.select(F.col("id").alias("docid"), F.size("text").alias("n_texts"))
    return qrels.join(q, "qid").join(c, "docid").select("qid", "docid", "relevance", "query", "n_texts")


@query(
    "flatten_corpus",
    """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n - 1 AS INTEGER) AS pos, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.split("text", "\n").alias("text")
    )
    return records.flatten_corpus(corpus)


@query(
    "apply_instruction",
    f"""WITH {TRAINING_SQL}
SELECT id, CASE WHEN id % 2 = 0 THEN title ELSE 'Find facts' END || ': ' || query AS query,
       array_to_string(list_transform(pos, lambda p: '[fact] ' || p), '|') AS passages FROM training""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir).select(
        "id", "query", F.col("pos").alias("passages"), F.when(F.col("id") % 2 == 0, F.col("title")).alias("prompt")
    )
    told = training.apply_instruction(rows, "Find facts", "{}: {}", "[fact]", "{} {}")
    return told.select("id", "query", F.array_join("passages", "|").alias("passages"))


@query(
    "shuffle_chunks",
    """WITH sized AS (
  SELECT doc_id, text, length(text) AS n, length(text) // 3 + 1 AS size,
         ('0x' || substr(md5('42:shuffle:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents),
chunks AS (
  SELECT doc_id, spot, substring(text, CAST(spot AS INTEGER), CAST(size AS INTEGER)) AS chunk
  FROM (SELECT doc_id, text, size, unnest(range(1, n + 1, size)) AS spot FROM sized WHERE n > 100 AND u < 0.5)),
joined AS (
  SELECT doc_id, string_agg(chunk, ' ' ORDER BY md5('42:chunk:' || doc_id || ':' || spot)) AS t FROM chunks GROUP BY doc_id)
SELECT s.doc_id, coalesce(j.t, s.text) AS text FROM sized s LEFT JOIN joined j USING (doc_id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.shuffle_chunks("text", 0.5, "doc_id").alias("text"))


@query("union_datasets", "SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return records.union_datasets(a, b)


@query(
    "max_token_len",
    f"""WITH {TRAINING_SQL},
passages AS (SELECT unnest(list_concat(pos, neg)) AS t FROM training)
SELECT (SELECT CAST(max(len(list_filter(string_split_regex(query, '[\\t-\\r ]+'), lambda w: w <> ''))) AS INTEGER) FROM training)
         AS query_max_len,
       (SELECT CAST(max(len(list_filter(string_split_regex(t, '[\\t-\\r ]+'), lambda w: w <> ''))) AS INTEGER) FROM passages)
         AS passage_max_len""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.max_token_len(training_rows(spark, sf_dir))


@functools.cache
def _make_byte_pair_counts():
    """Token counts of a public byte-level tokenizer; the pieces a worker has met outlive the task."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return records.counts_by_pieces(
        lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], special
    )


# No SQL: it can't split texts as the tokenizer's merges do. A test counts every text on its own.
@query("max_token_len_subwords")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.max_token_len(training_rows(spark, sf_dir), make_tokenizer=_make_byte_pair_counts)


_TEACHER_SQL = """
    list_transform(range(len(pos)), lambda i: CAST(i + 1 AS DOUBLE)) AS pos_scores,
    list_transform(range(len(neg)), lambda i: CAST(i AS DOUBLE) / 2) AS neg_scores"""


@query(
    "training_groups",
    f"""WITH {TRAINING_SQL},
scored AS (SELECT *, {_TEACHER_SQL},
           CASE WHEN len(neg) < 7 THEN (7 + len(neg) - 1) // len(neg) ELSE 1 END AS reps FROM training),
one AS (
  SELECT id, i FROM (SELECT id, unnest(range(len(pos))) AS i FROM scored)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY md5('42:pos:' || id || ':' || i), i) = 1),
slots AS (
  SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY md5('42:neg:' || id || ':' || j), j) AS r
  FROM (SELECT id, unnest(range(len(neg) * reps)) AS j FROM scored)),
many AS (
  SELECT s.id, string_agg(neg[j % len(neg) + 1], '|' ORDER BY r) AS texts,
         string_agg(CAST(CAST(neg_scores[j % len(neg) + 1] * 2 AS INTEGER) AS VARCHAR), '|' ORDER BY r) AS scores
  FROM slots JOIN scored s USING (id) WHERE r <= 7 GROUP BY s.id)
SELECT id, query, pos[i + 1] || '|' || texts AS passages,
       CAST(CAST(pos_scores[i + 1] * 2 AS INTEGER) AS VARCHAR) || '|' || scores AS doubled_scores
FROM scored JOIN one USING (id) JOIN many USING (id)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    groups = training.training_groups(_scored(rows), distill=True)
    doubled = F.transform("teacher_scores", lambda s: (s * 2).cast("int").cast("string"))
    return groups.select(
        "id", "query", F.array_join("passages", "|").alias("passages"), F.array_join(doubled, "|").alias("doubled_scores")
    )
