"""Training folders to query-passage groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.functions.draws import SEED
from gleaner.operators.sampling import cap_rows
from gleaner.operators.training import apply_instruction, training_groups
from gleaner.sources.tables import file_columns, read_training_dirs, score_columns_policy


def load_training_rows(
    spark: SparkSession,
    entries: Sequence[str],
    distill: bool = False,
    max_rows: int = 100_000_000,
    seed: int = SEED,
) -> DataFrame:
    """The rows of all files among the entries, at most max_rows of each file, with column file.

    With distill every file must have score columns, asked of the keys of its lines; without it they are dropped. Rows of a file are sampled
    by their content, so it does not matter how files are split.
    """
    rows = read_training_dirs(spark, entries)
    columns = file_columns(spark, entries) if distill else None
    rows = score_columns_policy(rows, distill, file_col="file", columns=columns)
    content = F.md5(F.to_json(F.struct(*[c for c in rows.columns if c != "file"])))
    return cap_rows(rows.withColumn("_key", content), "file", "_key", max_rows, seed).drop("_key")


def load_training_groups(
    spark: SparkSession,
    entries: Sequence[str],
    group_size: int = 8,
    distill: bool = False,
    max_rows: int = 100_000_000,
    seed: int = SEED,
    q_inst: str | None = None,
    q_fmt: str = "{}{}",
    p_inst: str | None = None,
    p_fmt: str = "{}{}",
) -> DataFrame:
    """Folders, cap for each file, score policy, groups and instructions in one flow."""
    rows = load_training_rows(spark, entries, distill, max_rows, seed)
    groups = training_groups(rows, group_size, distill, seed)
    return apply_instruction(groups, q_inst, q_fmt, p_inst, p_fmt)
