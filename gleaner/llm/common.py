"""What the operators share: stored intermediate tables, words of a text, Arrow passes over texts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gleaner.session import new_path

#: Words are runs of anything but ASCII white space; the Python side of it is bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20  # of texts that a Python pass works on at once
ROW = "_gleaner_row"  # a whole input row as one struct, so that its columns can't clash with ours


#: Rows in an Arrow batch where the session has Spark's default of 10,000, which for texts is tens of megabytes
#: on both sides of each worker.
BATCH_ROWS, BATCH_SETTING = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_BROADCAST = 100_000  # rows of a few numbers each, counted before they are broadcast


def short_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


class Scratch:
    """Intermediate tables in the shared folder. Written tables survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.used = spark, new_path(spark, name), 0
        short_batches(spark)

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        self.used += 1
        path = f"{self.dir}/{self.used}"
        df.write.options(**options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def keep_small(self, df: DataFrame) -> DataFrame:
        """As keep; the table is broadcast to joins if it has MOST_BROADCAST rows or fewer, else shuffled."""
        kept = self.keep(df)
        return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of steps whose results are written.

        It does so once the driver's JVM has collected the finished plans, which else may take very long.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes; a longer row is a run of its own."""
    row = batch.nbytes // max(1, batch.num_rows)
    sizes = np.full(batch.num_rows, row, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type):
            sizes = np.maximum(sizes, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def arrow_pass(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One Python pass over the rows of each partition, some SLICE_BYTES at a time, which bounds its memory."""

    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := fn(part)) is not None:
                    yield out
            # Arrow keeps what it has freed; a worker lives on and shares its memory with the next stages.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns are not scanned."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, scratch: Scratch) -> DataFrame:
    """df with the sum of value over all rows before each row in the given order, which should be total.

    Rows are put in order by a range shuffle and written; sums run inside each range partition, and only
    one total for each of these is summed up in one task and broadcast.
    """
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return ranged.join(F.broadcast(totals), "_part").withColumn(out, total.cast("long")).drop("_part", "_before")


def word_count(text: Column) -> Column:
    """Number of words, natively. Null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's longs, bit for bit."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def spans(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive runs of these lengths, and the total at the end."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of consecutive runs of these lengths."""
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(spans(lengths)[:-1], lengths)
