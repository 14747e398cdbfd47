"""Training rows to query-passage groups. Everything is row-local: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions.draws import SEED, draw
from gleaner.functions.text import fill_format, shuffle_chunks


def _by_draw(indices: Column, seed: int, *key) -> Column:
    """The indices in drawn order."""
    drawn = F.transform(indices, lambda i: F.struct(draw(seed, *key, i).alias("d"), i.alias("i")))
    return F.transform(F.array_sort(drawn), lambda s: s["i"])


def training_groups(
    df: DataFrame,
    group_size: int = 8,
    distill: bool = False,
    seed: int = SEED,
    key: str = "id",
    shuffle_ratio: float = 0.0,
) -> DataFrame:
    """(key, query, passages, teacher_scores): one drawn positive, then group_size - 1 drawn negatives.

    A row with fewer negatives draws from its list repeated as often as needed. With distill the scores
    of the same picks come along, and a score that is missing or no number is an error.
    """
    wanted = group_size - 1
    n_pos, n_neg = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(1)) for c in ("pos", "neg"))
    repeats = F.when(n_neg < wanted, F.ceil(F.lit(wanted) / n_neg)).otherwise(F.lit(1)).cast("int")
    slots = F.sequence(F.lit(0), n_neg * repeats - 1)
    one = _by_draw(F.sequence(F.lit(0), n_pos - 1), seed, F.lit("pos"), key)[0]
    many = F.slice(_by_draw(slots, seed, F.lit("neg"), key), 1, wanted)
    empty = F.coalesce(F.size("pos"), F.lit(0)) <= 0
    if wanted:  # negatives are needed only where some are drawn
        empty = empty | (F.coalesce(F.size("neg"), F.lit(0)) <= 0)
    refused = F.raise_error(F.concat(F.lit("no positives or no negatives in row "), F.col(key).cast("string")))
    # A filter is not pruned away, whichever columns are read later.
    df = df.where(F.when(empty, refused.cast("boolean")).otherwise(True))
    if not wanted:
        many = F.array().cast("array<int>")
    picked = df.withColumn("_one", one).withColumn("_many", F.transform(many, lambda i: F.pmod(i, n_neg)))
    positive = shuffle_chunks(F.get("pos", F.col("_one")), shuffle_ratio, key, seed=seed)
    passages = F.concat(F.array(positive), F.transform("_many", lambda i: F.get("neg", i)))
    out = picked.withColumn("passages", passages)
    teacher = F.lit(None).cast("array<double>")
    if distill:
        scores = F.concat(
            F.array(F.get("pos_scores", F.col("_one"))), F.transform("_many", lambda i: F.get("neg_scores", i))
        ).cast("array<double>")
        bad = F.exists(scores, lambda s: s.isNull()) | scores.isNull()
        refused = F.raise_error(F.concat(F.lit("pos_scores or neg_scores hold no number in row "), F.col(key).cast("string")))
        teacher = F.when(bad, refused.cast("array<double>")).otherwise(scores)
    keep = [key, "query", "passages"] + (["prompt"] if "prompt" in df.columns else [])
    return out.select(*keep, teacher.alias("teacher_scores"))


def apply_instruction(
    df: DataFrame,
    q_inst: str | None = None,
    q_fmt: str = "{}{}",
    p_inst: str | None = None,
    p_fmt: str = "{}{}",
) -> DataFrame:
    """Puts the row's prompt, else the common instruction, before the query; likewise for passages."""
    if q_inst is not None:
        own = F.coalesce("prompt", F.lit(q_inst)) if "prompt" in df.columns else F.lit(q_inst)
        df = df.withColumn("query", fill_format(q_fmt, own, F.col("query")))
    if p_inst is not None:
        df = df.withColumn("passages", F.transform("passages", lambda p: fill_format(p_fmt, F.lit(p_inst), p)))
    return df
