"""Packing of documents into training sequences by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch, arrow_pass, id_and_text
from gleaner.llm.tokens import TOKENIZER, word_ids

WINDOW = 4096
END = 2  # the id that ends a document
GROUP = 16_384  # pieces packed together in one task

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over the capacities finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)  # open windows below each node; a leaf is one capacity
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, room: int) -> None:
        if room:
            self.windows[room].append(window)
            self._count(room, 1)

    def tightest(self, length: int) -> int | None:
        """Takes the window with the least room of at least length; its room is found in self.room."""
        open_, node = self.open, self.leaves + length
        if not open_[node]:
            # Up to the first right neighbour with an open window, then down its left side.
            while node > 1 and (node & 1 or not open_[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not open_[node]:
                    node += 1
        self.room = node - self.leaves
        self._count(self.room, -1)
        return self.windows[self.room].pop()

    def _count(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += change
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; pieces of equal length keep their order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.tightest(length)
        if found is None:
            found, tree.room, used = used, capacity, used + 1
        window[i], offset[i] = found, capacity - tree.room
        tree.add(found, tree.room - length)
    return window, offset


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's ids and the end id, cut into full windows and one rest.

    (doc_id, start, length, ids_crc32, doc_tokens), and ids (array of int) if asked for. A null text is
    empty and gives the end id alone.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    end = np.array([END], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids, rows, ids = batch.column(0).to_pylist(), [], []
        for doc_id, found in zip(doc_ids, word_ids(tokenizer)(batch.column(1).to_pylist())):
            found += end
            total = len(found) // 4
            for start in range(0, total, window):
                piece = found[4 * start : 4 * (start + window)]
                rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total))
                if with_ids:
                    ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return arrow_pass(id_and_text(docs, id_col, text_col), cut, schema)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of token_pieces with sequence_id and offset: where each lies in the packed sequences.

    Full windows are sequences of their own. Rests are dealt evenly over groups of about GROUP pieces, and
    each group is packed by best-fit decreasing in one task, so that padding is the open windows that a
    group ends with. Tokens are made once, in a written table. Null doc_ids, repeated rows and ties are packed like any others;
    every id lies in exactly one piece. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, id_col, text_col, window, tokenizer, with_ids))
    pieces = pieces.withColumn("piece", F.monotonically_increasing_id())
    n = pieces.where(f"length < {window}").count()
    groups = max(1, -(-n // GROUP))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rests = pa.Table.from_batches(held)
            at, offset = best_fit_decreasing(rests.column("length").to_numpy(), window)
            group = rests.column("group").to_numpy()
            sequence = (group.astype(np.int64) << 32) + at
            columns = [rests.column(c).combine_chunks() for c in rests.column_names if c != "group"]
            names = [c for c in rests.column_names if c != "group"] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(sequence), pa.array(offset)], names)

    group = F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int")
    rests = pieces.where(f"length < {window}").withColumn("group", group).drop("piece")
    schema = rests.drop("group").schema
    schema.add("sequence_id", "long").add("offset", "long")
    packed = rests.repartitionById(groups, "group").mapInArrow(pack, schema)
    full = pieces.where(f"length = {window}").withColumns(
        {"sequence_id": -1 - F.col("piece"), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full.drop("piece"))
