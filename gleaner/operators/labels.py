"""Label counts, class filters and title lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.functions.text import first_label, split_labels
from gleaner.operators.skew import left_join_hot_right, skew_join


def count_labels_multi(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    return df.select(F.explode(split_labels(col, sep)).alias("label")).groupBy("label").count()


def count_labels_single(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    return df.groupBy(first_label(col, sep).alias("label")).count()


def count_at_least(counts: DataFrame, k: int) -> DataFrame:
    return counts.where(F.col("count") >= k)


def collect_by_class(df: DataFrame, label: str, min_n: int, spread: list[str] | None = None) -> DataFrame:
    """The rows of the classes with at least min_n rows, in long form."""
    large = df.groupBy(label).count().where(F.col("count") >= min_n).select(label)
    return skew_join(df, large, [label], "left_semi", spread)


def top_labels(counts: DataFrame, n: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("count"), "label").limit(n)


def first_by_title(dim: DataFrame, title: str = "title", id_col: str = "id") -> DataFrame:
    """One row per title, the one with the lowest id; ids are unique, and no text goes through the grouping."""
    lowest = dim.groupBy(title).agg(F.min(id_col).alias(id_col))
    return dim.join(lowest, [title, id_col], "left_semi")


def lookup_required(
    labels: DataFrame, dim: DataFrame, label: str = "label", spread: list[str] | None = None
) -> DataFrame:
    """Adds id and text of the query whose title equals the label. A label without one is an error."""
    titles = first_by_title(dim.select("title", "id", "content"))
    missed = label_difference(labels, dim.select(F.col("title").alias(label)), label)
    missed = missed.orderBy(label).limit(20).collect()
    if missed:
        raise ValueError("no query has the title: " + ", ".join(str(row[0]) for row in missed))
    texts = titles.select(F.col("title").alias(label), "id", F.col("content").alias("text"))
    return skew_join(labels, texts, [label], "left", spread)


def label_difference(a: DataFrame, b: DataFrame, label: str = "label") -> DataFrame:
    """Labels of a that b lacks."""
    return a.select(label).distinct().join(b.select(label).distinct(), [label], "left_anti")


def missing_labels(test: DataFrame, train: DataFrame, dim: DataFrame, label: str = "label") -> DataFrame:
    """Test labels the training subset lacks, with their content in the full table."""
    full = dim.select(F.col("title").alias(label), "id", "content")
    return left_join_hot_right(label_difference(test, train, label), full, [label], ["id"])
