"""Row-wise reshaping of query, positive and corpus tables, and checks on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.functions.text import instruction_text, render_prompt, respace_title
from gleaner.functions.vectors import max_abs_diff

RESPONSE_SCHEMA = "id long, title string, query string, pos array<string>"


def map_rows(df: DataFrame, columns: dict[str, Column], remove: list[str] | None = None) -> DataFrame:
    """A row-wise map: new or replaced columns, then removal of others."""
    return df.withColumns(columns).drop(*(remove or []))


BatchMap = Callable[[pa.RecordBatch], Mapping[str, pa.Array | np.ndarray | list]]


def map_batches(
    df: DataFrame,
    make_fn: Callable[[], BatchMap],
    schema: str | T.StructType,
    remove: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    batch_rows: int = 1000,
) -> DataFrame:
    """A map of batches of rows: adds or replaces the columns of schema, then removes others.

    make_fn runs once per task, so that costly state is made once, and returns a function from an Arrow batch
    of at most batch_rows rows to the columns of the schema. It gets the given columns only (all if None); the
    rows, their order and all other columns stay as they are. A result without one of the columns, of another
    length or of values that are not of the declared type is an error. A function that is to make more or fewer
    rows removes all columns that it doesn't return.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    declared = declared.toNullable()
    gone = set(remove) | set(declared.fieldNames())
    kept = [f for f in df.schema.fields if f.name not in gone]
    lacking = [c for c in [*remove, *(columns or ())] if c not in df.columns]
    if lacking:
        raise ValueError("no such columns: " + ", ".join(lacking))
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    out = T.StructType([*kept, *declared.fields]).toNullable()
    arrow, names = to_arrow_schema(out), declared.fieldNames()
    whole = arrow.names[: len(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make_fn()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                found = fn(part.select(list(columns)) if columns is not None else part)
                absent = [n for n in names if n not in found]
                if absent:
                    raise ValueError("the function returns no column " + ", ".join(absent))
                made = [_as_array(found[n], arrow.field(n).type) for n in names]
                if len({len(x) for x in made} | ({part.num_rows} if whole else set())) > 1:
                    raise ValueError(f"the function made columns of {[len(x) for x in made]} rows of {part.num_rows}")
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(arrow.field(c).type) for c in whole), *made], schema=arrow)

    return df.mapInArrow(run, out)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def lift_query(df: DataFrame, law: str) -> DataFrame:
    """Old-format rows {id, query: {title, content}} to flat ones with a respaced title."""
    flat = {"title": respace_title(F.col("query.title"), law), "content": F.col("query.content")}
    return map_rows(df, flat, ["query"])


def render_prompts(df: DataFrame, template: str, k: int) -> DataFrame:
    """(id, instructions, prompt): what a generator is asked for every query row."""
    return df.select(
        "id", F.lit(instruction_text(template, k)).alias("instructions"),
        render_prompt("id", "title", "content").alias("prompt"),
    )


def merge_generated(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """Queries (id, title, content) with the positives of their response (request_id, response).

    A missing or malformed response keeps the row, with no positives. A request answered several times gets
    its first readable response in text order, so a row comes out once. In id order.
    """
    parsed = responses.select(
        F.col("request_id").alias("id"), "response", F.from_json("response", RESPONSE_SCHEMA)["pos"].isNotNull().alias("_ok")
    )
    # One response of a request is left after this, however many there were; combined before the shuffle.
    answers = parsed.where("_ok").groupBy("id").agg(F.min("response").alias("_response"))
    joined = queries.select("id", "title", "content").join(answers, "id", "left")
    joined = joined.withColumn("_r", F.from_json("_response", RESPONSE_SCHEMA))
    ok = F.col("_r.pos").isNotNull()
    return joined.select(
        "id",
        F.when(ok, F.coalesce("_r.title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(ok, F.coalesce("_r.query", "content")).otherwise(F.col("content")).alias("query"),
        F.coalesce("_r.pos", F.array().cast("array<string>")).alias("pos"),
    ).orderBy("id")


def split_positives(df: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """A training copy with the first n positives and a held-out copy with the rest."""
    train = df.withColumn("pos", F.slice("pos", 1, n))
    heldout = df.withColumn("pos", F.slice("pos", F.lit(n + 1), F.greatest(F.size("pos"), F.lit(1))))
    return train, heldout


def check_list_sizes(df: DataFrame, col: str, id_col: str = "id") -> DataFrame:
    """Rows whose list is not as long as that of the first row, with both sizes."""
    sized = df.withColumn("size", F.size(col))
    expected = sized.agg(F.min_by("size", id_col).alias("expected"))  # one row
    return sized.join(F.broadcast(expected), F.col("size") != F.col("expected"))


def to_retrieval_tables(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, qrels) of generated rows; every row's document is relevant to its query."""
    id = F.col("id").cast("string")
    queries = df.select(id.alias("id"), F.col("query").alias("text"))
    corpus = df.select(id.alias("id"), F.col("pos").alias("text"))
    qrels = df.select(id.alias("qid"), id.alias("docid"), F.lit(1).alias("relevance"))
    return queries, corpus, qrels


def flatten_corpus(corpus: DataFrame) -> DataFrame:
    """(id, pos, text): one row per passage; the document's id stays with each."""
    return corpus.select("id", F.posexplode("text").alias("pos", "text"))


def union_datasets(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


Tokenizer = Callable[[list[str]], Sequence[int]]


MOST_PIECES = 400_000  # pieces a task remembers, the first it meets: common ones come early
LONG_PIECE = 64  # longer ones are not remembered


def counts_by_pieces(count: Tokenizer, special: Sequence[str] = ()) -> Tokenizer:
    """The same counts, of a tokenizer that always parts a text before a single space between two other signs.

    Byte-level tokenizers do. The pieces recur, so each is counted once and looked up from then on. Texts with one of
    the special strings, which a tokenizer may find anywhere, are counted whole.
    """
    met, later = {}, {}  # counts of pieces, and of those after a space by what follows it

    def cut(text: str) -> tuple[list[str], list[str]]:
        parts = text.split(" ")
        if parts == text.split():  # no other white space, and no run of spaces
            return parts[:1], parts[1:]
        return re.split(r"(?<=\S)(?= \S)", text), []

    def ask(texts: list[tuple[list[str], list[str]]]) -> list[str]:
        """Counts the pieces that were not met; those that are not to be remembered are handed back."""
        new = {p for first, _ in texts for p in first if p not in met}
        new_later = {p for _, rest in texts for p in rest if p not in later}
        found = iter(count([*new, *(" " + p for p in new_later)]))
        met.update(zip(new, found))
        later.update(zip(new_later, found))
        full = len(met) + len(later) > MOST_PIECES
        return [p for p in (*new, *new_later) if full or len(p) > LONG_PIECE]

    def counted(texts: list[str]) -> list[int]:
        out, open_texts, open_places = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            first, rest = ([text], []) if any(s in text for s in special) else cut(text)
            try:
                out[i] = sum(map(met.__getitem__, first)) + sum(map(later.__getitem__, rest))
            except KeyError:
                open_texts.append((first, rest))
                open_places.append(i)
        passing = ask(open_texts) if open_texts else []
        for i, (first, rest) in zip(open_places, open_texts):
            out[i] = sum(map(met.__getitem__, first)) + sum(map(later.__getitem__, rest))
        for piece in passing:
            met.pop(piece, None)
            later.pop(piece, None)
        return out

    return counted


def token_counts(make_tokenizer: Callable[[], Tokenizer], batch: int = 1000) -> Callable[[Column], Column]:
    """An expression for the longest of the token counts of a list of texts, null for an empty list.

    make_tokenizer runs once per task and returns a function from texts, `batch` at most, to their numbers of
    tokens. Null texts are not counted.
    """

    @F.arrow_udf("int")
    def longest(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = make_tokenizer()
        for lists in parts:
            texts = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            valid = texts.is_valid().to_numpy(zero_copy_only=False)
            texts, row = texts.filter(pa.array(valid)), row[valid]
            most = np.full(len(lists), -1, dtype=np.int64)
            for at in range(0, len(texts), batch):
                found = np.asarray(count(texts.slice(at, batch).to_pylist()), dtype=np.int64)
                if len(found) != len(texts[at : at + batch]):
                    raise ValueError(f"{len(found)} counts of {len(texts[at : at + batch])} texts")
                np.maximum.at(most, row[at : at + batch], found)
            yield pa.array(most, pa.int32(), mask=most < 0)

    return longest


def max_token_len(
    df: DataFrame, tokens: Callable[[Column], Column] = whitespace_tokens,
    make_tokenizer: Callable[[], Tokenizer] | None = None,
) -> DataFrame:
    """Largest token count of the queries, and of the passages over positives and negatives.

    tokens is an expression for the tokens of a text. make_tokenizer takes its place where a library has to be
    asked: it runs once per task, and what it returns counts the tokens of many texts at once.
    """
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("pos", "neg") if c in df.columns]
    passages = F.concat(*lists)
    if make_tokenizer:
        longest = token_counts(make_tokenizer)
        found = df.select(longest(F.array("query")).alias("q"), longest(passages).alias("p"))
    else:
        counts = F.transform(passages, lambda t: F.size(tokens(t)))
        found = df.select(F.size(tokens(F.col("query"))).alias("q"), F.array_max(counts).alias("p"))
    return found.agg(F.max("q").alias("query_max_len"), F.max("p").alias("passage_max_len"))


def compare_embeddings(
    a: DataFrame, b: DataFrame, tol: float = 1e-6, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """Largest element difference of two encoders' vectors of the same text, and whether it is within tol."""
    left = a.select(id_col, F.col(vec).alias("_a"))
    right = b.select(id_col, F.col(vec).alias("_b"))
    diff = left.join(right, id_col).withColumn("max_diff", max_abs_diff("_a", "_b"))
    return diff.select(id_col, "max_diff", (F.col("max_diff") <= tol).alias("equal"))
