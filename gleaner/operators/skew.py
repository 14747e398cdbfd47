"""Joins whose left side may hold a very hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.session import checkpointed

HOT_ROWS = 1_000_000  # rows one task may take for a single key
MOST_BROADCAST = 100_000  # rows of the table of hot keys, 16 bytes each, up to which it is broadcast


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """(key hash, number of shares) of all keys with over hot_rows rows. Counts are combined before the shuffle."""
    hot_rows = hot_rows or HOT_ROWS
    counts = df.groupBy(F.xxhash64(*keys).alias("_kh")).count().where(F.col("count") > hot_rows)
    return counts.select("_kh", F.ceil(F.col("count") / hot_rows).cast("int").alias("_shares"))


def small_table(df: DataFrame) -> tuple[DataFrame, int]:
    """A table that may have any size, computed once, and its row count up to MOST_BROADCAST + 1.

    Within that many rows it is marked for broadcast. Beyond, it is written and joined like any other table.
    """
    rows = df.limit(MOST_BROADCAST + 1).collect()
    if len(rows) <= MOST_BROADCAST:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), len(rows)
    return checkpointed(df), len(rows)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    right_spread: Sequence[str] | None = None,
    hot_rows: int | None = None,
    sized_by: DataFrame | None = None,
    hot_on: Sequence[str] | None = None,
) -> DataFrame:
    """Equi join for how in inner, left, left_semi, left_anti that stands hot keys.

    Rows of a hot key on the left are dealt over several shares by the hash of the spread columns, and
    the right side's rows of that key are repeated once per share. With right_spread (inner join only)
    the right side's hot keys are dealt the same way. Without hot keys it is a plain join. sized_by counts
    the left keys in another table, where that is cheaper; hot_on takes hotness from part of the key.
    left_join_hot_right does a left join whose right side is the hot one.
    """
    on, hot_on = list(on), list(hot_on or on)
    if right_spread and how != "inner":
        raise ValueError("only an inner join can deal its right side")
    table = hot_keys(sized_by if sized_by is not None else left, hot_on, hot_rows)
    table = table.withColumnRenamed("_shares", "_nl").withColumn("_nr", F.lit(1))
    if right_spread:
        theirs = hot_keys(right, hot_on, hot_rows).select("_kh", F.lit(1).alias("_nl"), F.col("_shares").alias("_nr"))
        table = table.unionByName(theirs).groupBy("_kh").agg(F.max("_nl").alias("_nl"), F.max("_nr").alias("_nr"))
    table, size = small_table(table)
    if not size:
        return left.join(right, on, how)
    n_left, n_right = F.coalesce("_nl", F.lit(1)), F.coalesce("_nr", F.lit(1))

    def dealt(columns: Sequence[str], n: Column) -> Column:
        return F.pmod(F.xxhash64(*columns), n.cast("long")).cast("int")

    def every(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), n - 1))

    l = left.withColumn("_kh", F.xxhash64(*hot_on)).join(table, "_kh", "left")
    r = right.withColumn("_kh", F.xxhash64(*hot_on)).join(table, "_kh", "left")
    l = l.withColumn("_ls", dealt(spread or left.columns, n_left)).withColumn("_rs", every(n_right))
    r = r.withColumn("_rs", dealt(right_spread or on, n_right)).withColumn("_ls", every(n_left))
    l, r = l.drop("_kh", "_nl", "_nr"), r.drop("_kh", "_nl", "_nr")
    return l.join(r, on + ["_ls", "_rs"], how).drop("_ls", "_rs")


def left_join_hot_right(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Left join for a right side with hot keys; the left side has few rows per key."""
    on = list(on)
    if hot_keys(right, on, hot_rows).isEmpty():
        return left.join(right, on, "left")
    matched = skew_join(right, left, on, "inner", spread, hot_rows=hot_rows)
    unmatched = left.join(right.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer partitions than cores is dealt over all cores; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores, *keys)


def as_columns(order_by: Sequence[str | Column] | str) -> list[Column]:
    if isinstance(order_by, str):
        order_by = [order_by]
    return [F.col(c) if isinstance(c, str) else c for c in order_by]
