"""Aggregates that combine before the shuffle: vector sums and means, log-sum-exp."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

LSE_STEP = 500.0  # exp of half a step stays far inside the range of a double


def _by_group(table: pa.Table, keys: Sequence[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(keys of each group in order of first occurrence, row numbers group by group, start of each group)."""
    placed = table.select(list(keys)).append_column("_at", pa.array(np.arange(len(table))))
    groups = placed.group_by(list(keys), use_threads=False).aggregate([("_at", "list"), ("_at", "min")])
    groups = groups.sort_by("_at_min")  # Arrow's own order of groups is none to rely on
    lists = groups.column("_at_list").combine_chunks()
    rows, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy()[:-1]
    return groups.select(list(keys)), rows, starts - (starts[0] if len(starts) else 0)


def reduce_in_arrow(df: DataFrame, keys: Sequence[str], combine: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """One row per key. combine makes a table with one row per key of any rows, and may be used on its results.

    It is used on each Arrow batch before the shuffle and on the rows of a key after it, so a hot key
    sends one row for each batch it is in, and wide vectors need neither sorting nor an expression for
    each element. Whatever types and names combine gives its columns, rows go on in the schema of df: what is
    held of one batch meets the next one in the same types.
    """
    schema = df.schema.toNullable()
    declared = to_arrow_schema(schema)

    def combined(table: pa.Table) -> pa.Table:
        return combine(table).select(declared.names).cast(declared).combine_chunks()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from combined(pa.Table.from_batches([batch])).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = declared.empty_table()  # the last key of a batch may go on in the next one
        for batch in batches:
            if batch.num_rows:
                found = combined(pa.concat_tables([held, pa.Table.from_batches([batch]).cast(declared)]))
                yield from found.slice(0, len(found) - 1).to_batches()
                held = found.slice(len(found) - 1)
        yield from held.to_batches()

    partial = df.mapInArrow(first, schema)
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def _vector_totals(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """(keys, vec, _n): element-wise sums and numbers of vectors; all have one length and no null elements."""
    rows = df.where(F.col(vec).isNotNull()).select(
        *keys, F.col(vec).cast("array<double>").alias(vec), F.lit(1).cast("long").alias("_n")
    )

    def combine(table: pa.Table) -> pa.Table:
        groups, order, starts = _by_group(table, keys)
        vectors = table.column(vec).combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        if (sizes != sizes[0]).any():
            raise ValueError("vectors of one column differ in length")
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        sums = np.add.reduceat(matrix[order], starts, axis=0)
        counts = np.add.reduceat(table.column("_n").to_numpy()[order], starts)
        offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
        lists = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
        return groups.append_column(vec, lists).append_column("_n", pa.array(counts)).select(table.column_names)

    return reduce_in_arrow(rows, keys, combine)


def vector_sum(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    """Element-wise sum per key, as doubles. Null vectors are passed over."""
    return _vector_totals(df, keys, vec).drop("_n")


def vector_mean(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    totals = _vector_totals(df, keys, vec)
    return totals.select(*keys, F.transform(vec, lambda x: x / F.col("_n")).alias(vec))


def first_by(df: DataFrame, key: str, order: str, last: bool = False) -> DataFrame:
    """The row of each key with the smallest value of order, or with the largest."""

    def combine(table: pa.Table) -> pa.Table:
        _, rows, starts = _by_group(table, [key])
        places = table.column(order).to_numpy()[rows]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        best = np.lexsort((-places if last else places, of))
        return table.take(pa.array(rows[best[starts]]))

    return reduce_in_arrow(df, [key], combine)


def log_sum_exp(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "lse", also: Sequence = ()
) -> DataFrame:
    """ln(sum(exp(value))) per key without a pass for the maximum; also: further sums of the same pass.

    Values are summed per step of 500 relative to its middle, so nothing overflows and the sums combine
    before the shuffle. Of a key's steps only the two highest can matter in double precision.
    """
    step = F.round(F.col(value) / LSE_STEP)
    extra = [f"_x{i}" for i in range(len(also))]
    sums = df.groupBy(*keys, step.alias("_step")).agg(
        F.sum(F.exp(F.col(value) - step * LSE_STEP)).alias("_sum"),
        *[F.sum(c).alias(x) for c, x in zip(also, extra)],
    )
    # A key has as many rows here as steps its values reach.
    top = F.max("_step").over(Window.partitionBy(*keys))
    shifted = F.when(F.col("_step") >= top - 1, F.col("_sum") * F.exp((F.col("_step") - top) * LSE_STEP))
    rest = sums.withColumn("_part", shifted).withColumn("_top", top)
    return rest.groupBy(*keys).agg(
        (F.max("_top") * LSE_STEP + F.log(F.sum("_part"))).alias(out),
        *[F.sum(x).alias(x) for x in extra],
    )
