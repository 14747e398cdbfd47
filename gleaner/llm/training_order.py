"""Training-order materialisation: a keyed permutation of all sequences, written as fixed-stride shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gleaner.llm.common import Scratch, id_and_text
from gleaner.llm.tokens import TOKENIZER, word_ids

LENGTH = 1024  # ids in a sequence
SHARD = 32_768  # sequences in a shard: 64 MB
KEY = 42
ROUNDS = 6
END = 2  # the id that ends a document
PAD = 49_407  # the id that fills the last sequence of a part of the input
GAP = b"\0\0"  # one more id after each sequence, zero: the line end of Spark's text writer


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A keyed permutation of 0..n-1.

    A balanced Feistel network permutes the smallest even number of bits that holds n; a value that leaves
    the range walks on along its cycle until it comes back in, which takes four steps on average at most.
    """

    def __init__(self, n: int, key: int = KEY):
        self.n, self.half = n, max(1, -(-max(1, n - 1).bit_length() // 2))
        with np.errstate(over="ignore"):
            rounds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = _mix(rounds ^ _mix(np.array([key], dtype=np.uint64)))

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        shift, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right ^ k) & mask)
        return (left << shift) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, lambda x: self._once(x, self.keys))

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        """The inverse: which sequence is read at a slot."""
        swap, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        turn = lambda x: (x >> swap) | ((x & mask) << swap)
        return self._walk(slot, lambda x: turn(self._once(turn(x), self.keys[::-1])))


def token_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str = TOKENIZER
) -> DataFrame:
    """(part, place, n_tokens, ids binary): the documents of each input partition end to end, cut every length ids.

    Ids are little-endian unsigned 16-bit. Each document ends with END; the last sequence of a partition is
    filled up with PAD, so at most one sequence for each partition is short.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.spark_partition_id().alias("part"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, place, part = word_ids(tokenizer), b"", 0, None
        end, stride = np.array([END], dtype="<u2").tobytes(), 2 * length

        def batch_of(ids: bytes, n: int) -> pa.RecordBatch:
            nonlocal place
            ids += np.full((-len(ids) // 2) % length, PAD, dtype="<u2").tobytes()
            pieces = [ids[i : i + stride] for i in range(0, len(ids), stride)]
            sizes = np.minimum(length, n - length * np.arange(len(pieces)))
            places = np.arange(place, place + len(pieces))
            place += len(pieces)
            columns = [pa.array(np.full(len(pieces), part, np.int32)), pa.array(places), pa.array(sizes), pa.array(pieces, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "place", "n_tokens", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            found = [np.frombuffer(x, dtype="<u4").astype("<u2").tobytes() + end for x in encode(batch.column(1).to_pylist())]
            held += b"".join(found)
            if full := len(held) // stride * stride:
                yield batch_of(held[:full], full // 2)
                held = held[full:]
        if held:
            yield batch_of(held, len(held) // 2)

    return rows.mapInArrow(cut, "part int, place long, n_tokens long, ids binary")


def write_training_order(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    shard: int = SHARD,
    key: int = KEY,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Writes all sequences in training order under path; returns the index.

    Sequence s is read at slot Feistel(n, key).slot(s). Shard k, the file part-k, holds slots k * shard on,
    each 2 * length + 2 bytes long, so a reader seeks to any slot and reads on from there. Index rows:
    (sequence, slot, shard, record, n_tokens, ids_crc32 over the sequence's bytes).

    Tokens are made once and written; a lost executor repeats only its own partitions. The sequences cross
    the network once, straight into the task that writes their shard, which holds a fixed number of them. A
    null text gives its END alone; an empty table writes no shard. Documents keep the table's own order
    inside sequences; doc_ids are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "order")
    made = scratch.keep(token_sequences(docs, id_col, text_col, length, tokenizer), compression="zstd")
    parts = made.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row for each input partition
    before = F.sum("rows").over(Window.orderBy("part")) - F.col("rows")
    parts = scratch.keep(parts.select("part", before.alias("before"), "rows"))
    n = parts.agg(F.sum("rows")).first()[0] or 0
    order = Feistel(n, key)

    @F.pandas_udf("long")
    def slot_of(sequence):
        return type(sequence)(order.slot(sequence.to_numpy()))

    numbered = made.join(F.broadcast(parts), "part").withColumn("sequence", F.col("before") + F.col("place"))
    numbered = numbered.withColumn("slot", slot_of("sequence")).withColumns(
        {"shard": F.floor(F.col("slot") / shard), "record": F.col("slot") % shard}
    )
    if n:
        shards = -(-n // shard)
        placed = numbered.select("slot", F.col("shard").cast("int"), "ids").repartitionById(shards, "shard")
        lines = placed.sortWithinPartitions("slot").select(F.col("ids").cast("string").alias("value"))
        lines.write.option("lineSep", GAP.decode()).text(path)
    return numbered.select("sequence", "slot", "shard", "record", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def read_training_order(
    spark: SparkSession, path: str, first_slot: int = 0, length: int = LENGTH, shard: int = SHARD
) -> DataFrame:
    """(slot, ids array<int>) from a slot on, in files of whole shards; shards before it are not opened."""
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^part-(\d+)", 1).cast("long")
    files = spark.read.format("binaryFile").load(path).withColumn("shard", number)
    stride = 2 * length + len(GAP)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist()):
                table = np.frombuffer(content.as_py(), dtype="<u2").reshape(-1, stride // 2)[:, :length]
                slots = at * shard + np.arange(len(table))
                kept = slots >= first_slot
                ids = pa.ListArray.from_arrays(
                    pa.array(np.arange(kept.sum() + 1, dtype=np.int32) * length), pa.array(table[kept].astype(np.int32).ravel())
                )
                yield pa.RecordBatch.from_arrays([pa.array(slots[kept]), ids], ["slot", "ids"])

    wanted = files.where(F.col("shard") >= first_slot // shard).select("content", "shard")
    return wanted.mapInArrow(cut, "slot long, ids array<int>")
