"""Blocked matrix products: both sides are cut in blocks, one task multiplies one pair of blocks.

No pair of rows ever becomes a row of its own: a task hands back what its kernel keeps of the block
product (the best k, a log-sum-exp, a weighted sum).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.operators.skew import small_table

BLOCK_BYTES = 64 << 20  # one block of one side, as doubles
BATCH_ROWS = 8192  # rows of one batch per block: the work of a cell is the square of it
SLAB_BYTES = 8 << 20  # block products are taken in slabs that stay in cache


def vector_dim(df: DataFrame, vec: str) -> int:
    """Length of the vectors, read off one row."""
    row = df.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return row[0] if row else 1


def block_rows(dim: int, block_bytes: int | None = None) -> int:
    return max(256, (block_bytes or BLOCK_BYTES) // (8 * max(dim, 1)))


def batch_block_rows(dim: int) -> int:
    return min(BATCH_ROWS, block_rows(dim))


def parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def matrix(table: pa.Table, name: str) -> np.ndarray:
    """A list column of equal lengths as a 2-d array of doubles."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def packed(df: DataFrame, vec: str) -> tuple[DataFrame, np.dtype]:
    """df with its vectors as bytes, and the type of their elements: rows that are moved often are moved as one value."""
    dtype = np.dtype(np.float32 if isinstance(df.schema[vec].dataType.elementType, T.FloatType) else np.float64)

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        if len(flat) * dtype.itemsize >= 1 << 31:
            raise ValueError("a batch of vectors has over 2 GB; make Arrow batches smaller")
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False) * dtype.itemsize
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        out = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
        return pc.if_else(vectors.is_valid(), out, pa.scalar(None, pa.binary())) if vectors.null_count else out

    return df.withColumn(vec, pack(vec)), dtype


def unpacked(table: pa.Table, name: str, dtype: np.dtype) -> np.ndarray:
    """A column of packed vectors of equal lengths, none null, as a 2-d array of doubles."""
    parts = []
    for chunk in table.column(name).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk):
            whole = np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            parts.append(whole.view(dtype).astype(np.float64).reshape(len(chunk), -1))
    return np.concatenate(parts)


def unpacked_runs(table: pa.Table, name: str, dtype: np.dtype, n: int) -> np.ndarray:
    """As unpacked, of n vectors in all with several in a row, and with elements as they are."""
    parts = []
    for chunk in table.column(name).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk):
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return whole.view(dtype).reshape(n, -1)


def with_vector(table: pa.Table, name: str) -> pa.Table:
    column = table.column(name)
    return table.filter(column.is_valid()) if column.null_count else table


def detached(df: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup may stem from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def slabs(n_left: int, n_right: int):
    step = max(1, SLAB_BYTES // (8 * max(n_right, 1)))
    return (slice(at, at + step) for at in range(0, n_left, step))


MOST_TASKS = 20_000


MOST_NAMED = 4096  # cells that are given keys of their own


def spread_keys(n: int) -> list[int]:
    """For each of n partitions an int that Spark's hash partitioning sends there.

    Cells that are hashed by their numbers meet in some partitions and leave others empty. With these keys each
    has its own, and the groups' own partitioning is the one they come in: nothing is shuffled again.
    """
    tries = np.arange(n * (int(math.log(n)) + 20), dtype=np.uint32)

    def rotated(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    # The 32-bit Murmur hash of an int with seed 42, as F.hash has it.
    with np.errstate(over="ignore"):
        h = rotated(np.uint32(42) ^ rotated(tries * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13)
        h = h * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        h = h ^ h >> np.uint32(16)
    partition, first = np.unique(h.view(np.int32).astype(np.int64) % n, return_index=True)
    if len(partition) < n:  # hardly ever: as good a spread as hashing gives
        return list(range(n))
    return tries[first].tolist()


def _hot_batches(left: DataFrame, right: DataFrame, batch: str, rows: int) -> DataFrame:
    """(batch, _nl, _nr): blocks per side of the batches with more than `rows` rows on a side."""
    def marked(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.select(F.col(batch).alias(batch), F.lit(l).alias("_l"), F.lit(r).alias("_r"))

    sizes = marked(left, 1, 0).union(marked(right, 0, 1)).groupBy(batch).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))

    def blocks(side: str) -> Column:
        return F.greatest(F.ceil(F.col(side) / rows), F.lit(1)).cast("int")

    hot = sizes.where((F.col("_l") > rows) | (F.col("_r") > rows))
    return hot.select(batch, blocks("_l").alias("_nl"), blocks("_r").alias("_nr"))


def batch_cells(
    left: DataFrame,
    right: DataFrame,
    batch: str,
    id_col: str,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: T.StructType,
    rows: int,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Blocked products inside batches: kernel(left, right) sees rows of one batch, in blocks.

    sized_by holds the batch column of the rows of either side, where counting the sides themselves
    would repeat costly work.

    Small batches share a cell. A batch with more than `rows` rows on a side is cut in blocks by the
    hash of its ids, and each pair of its blocks is a cell, so no task takes a whole hot batch.
    """
    l_rows, r_rows = (sized_by, sized_by) if sized_by is not None else (left, right)
    sizes, hot = small_table(_hot_batches(l_rows, r_rows, batch, rows))
    n_rows = l_rows.count() + r_rows.count()
    buckets = max(parallelism(left), math.ceil(n_rows / (2 * rows)))

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        if hot:
            df = df.join(sizes, batch, "left")
        else:
            df = df.withColumn("_nl", F.lit(1)).withColumn("_nr", F.lit(1))
        mine, theirs = F.coalesce(f"_n{own}", F.lit(1)), F.coalesce(f"_n{other}", F.lit(1))
        return (
            df.withColumn("_cell", F.pmod(F.xxhash64(batch), F.lit(buckets)))
            .withColumn(f"_{own}b", F.pmod(F.xxhash64(id_col), mine.cast("long")).cast("int"))
            .withColumn(f"_{other}b", F.explode(F.sequence(F.lit(0), theirs - 1)))
            .drop("_nl", "_nr")
        )

    key = ["_cell", "_lb", "_rb"]
    tasks = min(2 * buckets, MOST_TASKS)
    l = placed(left, "l", "r").repartition(tasks, *key)
    r = placed(detached(right), "r", "l").repartition(tasks, *key)
    names = [f.name for f in schema.fields]

    empty = empty_like(schema)

    def spans(table: pa.Table) -> dict:
        # Sorted by batch; value_counts keeps the order of first occurrence.
        runs = table.column(batch).combine_chunks().value_counts()
        ends = np.cumsum(runs.field("counts").to_numpy())
        starts = ends - runs.field("counts").to_numpy()
        return dict(zip(runs.field("values").to_pylist(), zip(starts.tolist(), ends.tolist())))

    def per_batch(lt: pa.Table, rt: pa.Table) -> pa.Table:
        if not lt.num_rows or not rt.num_rows:
            return empty
        lt, rt = lt.sort_by(batch), rt.sort_by(batch)
        of_left, of_right = spans(lt), spans(rt)
        out = [empty]
        for value, (at, end) in of_left.items():
            if value in of_right:
                r_at, r_end = of_right[value]
                out.append(kernel(lt.slice(at, end - at), rt.slice(r_at, r_end - r_at)).select(names))
        return pa.concat_tables(out)

    return l.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(per_batch, schema)


def empty_like(schema: T.StructType) -> pa.Table:
    return to_arrow_schema(schema).empty_table()
