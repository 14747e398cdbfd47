"""Nested statute documents to flat clause rows and query rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import text as tx
from gleaner.operators.ordering import carry_headings, ids_by_group
from gleaner.session import new_path
from gleaner.sources.tables import table_roundtrip

# Field names of a statute document.
NUMBER, BRANCH, KEY, CONTENT = "조문번호", "조문가지번호", "조문키", "조문내용"
CLAUSES, CLAUSE_TEXT = "항", "항내용"
ITEMS, ITEM_TEXT = "호", "호내용"


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f'$["{name}"]', kind)


def _row(paragraph, subparagraph, content: Column) -> Column:
    return F.struct(
        F.lit(paragraph).cast("int").alias("paragraph"),
        F.lit(subparagraph).cast("int").alias("subparagraph"),
        content.alias("content"),
    )


def _item_rows(paragraph, items: Column) -> Column:
    rows = F.transform(items, lambda item, i: _row(paragraph, i + 1, _field(item, ITEM_TEXT)))
    return F.coalesce(rows, F.array())


def flatten_hierarchy(
    docs: DataFrame, law_id: str, seq: str, doc: str = "doc", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per article, clause and item, with cleaned content; keep names columns to carry along.

    doc is the JSON text of one article. Its clause field is a list of clauses, each with an optional
    list of items, or an object that holds items only; those get paragraph 0. All levels of a document
    are laid out in one array and exploded once, so the source is scanned once and nothing is shuffled.
    """
    v = F.col("_doc")
    heading = tx.preamble_flag(_field(v, KEY))
    clauses = F.transform(
        _field(v, CLAUSES, "array<variant>"),
        lambda clause, i: F.concat(
            F.array(_row(i + 1, 0, _field(clause, CLAUSE_TEXT))),
            _item_rows(i + 1, _field(clause, ITEMS, "array<variant>")),
        ),
    )
    bare_items = F.try_variant_get(v, f'$["{CLAUSES}"]["{ITEMS}"]', "array<variant>")
    below = F.concat(F.flatten(F.coalesce(clauses, F.array())), _item_rows(0, bare_items))
    own = F.array(_row(0, 0, _field(v, CONTENT)))
    branch = F.coalesce(F.nullif(_field(v, BRANCH), F.lit("")).cast("int"), F.lit(1))
    return (
        docs.select(law_id, seq, *keep, F.parse_json(doc).alias("_doc"))
        .select(
            law_id,
            seq,
            *keep,
            heading.alias("preamble"),
            _field(v, NUMBER).cast("int").alias("article"),
            branch.alias("article_branch"),
            F.explode(F.when(heading == 1, own).otherwise(F.concat(own, below))).alias("_row"),
        )
        .select(law_id, seq, *keep, "preamble", "article", "article_branch", "_row.*")
        .withColumn("content", tx.clean_text("content"))
    )


def clause_table(docs: DataFrame, law_id: str, seq: str, doc: str = "doc") -> DataFrame:
    """flatten_hierarchy plus the part and chapter each row stands under."""
    # Headings stand on article level: the state is carried over one narrow row for each document.
    own = tx.clean_text(F.get_json_object(doc, f"$['{CONTENT}']")).alias("_own")
    headed = carry_headings(docs.select(law_id, seq, own), law_id, seq, "_own").drop("_own")
    headed = headed.select(F.col(law_id).alias("_law"), F.col(seq).alias("_place"), "part", "chapter")
    same = F.col(law_id).eqNullSafe(F.col("_law")) & (F.col(seq) == F.col("_place"))
    joined = docs.select(law_id, seq, doc).join(headed, same)
    return flatten_hierarchy(joined, law_id, seq, doc, keep=("part", "chapter"))


def drop_headings(df: DataFrame) -> DataFrame:
    return df.where("preamble = 0").drop("preamble")


def drop_deleted(df: DataFrame, col: str = "content", marker: str = tx.DELETED_MARKER) -> DataFrame:
    return df.where(~tx.is_deleted(col, marker))


def query_table(clauses: DataFrame, law: str | Column, law_id: str, seq: str) -> DataFrame:
    """Clause rows to query rows: no headings, no deleted rows, titles, ids from 0 in source order."""
    kept = drop_deleted(drop_headings(clauses))
    titled = kept.select(law_id, seq, "paragraph", "subparagraph", tx.compose_title(law).alias("title"), "content")
    # Written once; the count of rows for each document then reads two columns of it.
    titled = table_roundtrip(titled, new_path(titled.sparkSession, "clauses"))
    numbered = ids_by_group(titled, [law_id, seq], ["paragraph", "subparagraph"])
    return numbered.select("id", "title", "content")
