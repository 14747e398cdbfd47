"""Seeded samples per group, exact for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.functions.draws import SEED, draw

# Up to this setting Spark cuts a ranked window before the shuffle.
RANK_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
_BUCKETS_HEX = 3  # 16^3 buckets per group beyond that


def sample_per_group(
    df: DataFrame, group: str, key: str, k: int, seed: int = SEED, salt: str = "sample"
) -> DataFrame:
    """k rows per group without replacement: those with the smallest draw. Smaller groups are kept whole.

    Rows without a group are a group of their own.
    """
    drawn = df.withColumn("_draw", draw(seed, F.lit(salt), key))
    if k <= int(df.sparkSession.conf.get(RANK_SETTING)):
        order = Window.partitionBy(group).orderBy("_draw", key)
        ranked = drawn.withColumn("_rank", F.row_number().over(order))
        return ranked.where(F.col("_rank") <= k).drop("_draw", "_rank")
    # A draw is uniform, so its leading digits cut a huge group in even buckets. Buckets that lie wholly
    # below the cut pass as they are; only rows of the one bucket the cut falls into are ranked.
    drawn = drawn.withColumn("_bucket", F.substring("_draw", 1, _BUCKETS_HEX))
    counts = drawn.groupBy(group, "_bucket").count()
    upto = F.sum("count").over(Window.partitionBy(group).orderBy("_bucket"))
    room = counts.select(
        F.col(group).alias("_of"), F.col("_bucket").alias("_in"), "count", (F.lit(k) - upto + F.col("count")).alias("_room")
    ).where("_room > 0")
    same = F.col(group).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in"))
    placed = drawn.join(room, same)
    whole, cut = placed.where("_room >= count"), placed.where("_room < count")
    inside = Window.partitionBy("_of", "_in").orderBy("_draw", key)
    cut = cut.withColumn("_rank", F.row_number().over(inside)).where(F.col("_rank") <= F.col("_room"))
    return whole.unionByName(cut.drop("_rank")).drop("_draw", "_bucket", "_of", "_in", "count", "_room")


def sample_k_per_class(df: DataFrame, label: str, key: str, k: int, seed: int = SEED) -> DataFrame:
    """k rows per class; a class with fewer is an error, as nothing smaller can be sampled."""
    sizes = df.groupBy(label).count().where(F.col("count") < k)
    small = sizes.orderBy(label).limit(20).collect()
    if small:
        names = ", ".join(f"{row[0]} ({row[1]})" for row in small)
        raise ValueError(f"classes with fewer than {k} rows: {names}")
    return sample_per_group(df, label, key, k, seed)


def cap_rows(
    df: DataFrame, file: str, key: str, max_rows: int = 100_000_000, seed: int = SEED
) -> DataFrame:
    """At most max_rows rows of each file, a seeded sample where it has more."""
    return sample_per_group(df, file, key, max_rows, seed, salt="cap")


def rank_range(hits: DataFrame, lo: int = 10, hi: int = 210, rank: str = "rank", lists: str | None = None) -> DataFrame:
    """Ranks lo..hi-1 counted from 0; the rank column counts from 1. lists names a column of hits in order of rank instead."""
    if lists:
        return hits.withColumn(lists, F.slice(lists, lo + 1, max(hi - lo, 0)))
    return hits.where((F.col(rank) > lo) & (F.col(rank) <= hi))
