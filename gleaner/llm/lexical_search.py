"""Ranked lexical search: tiles of item weights times tiles of document impacts, exact in doubles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.common import Scratch, arrow_pass, id_and_text, running_sum, spans

TILE_BYTES = 1 << 20  # of item texts that are searched in one pass over the documents; a longer item has its own
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 256, 2048, 1000  # rows and columns of the matrices that are multiplied
IMPACT = 1_000_000  # no impact reaches it
EXACT = 1 << 53  # whole numbers below it are exact in doubles

# Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lowered.
_APART = bytes(b for b in range(128) if not chr(b).isalnum())
_LOWER = bytes.maketrans(_APART + bytes(range(65, 91)), b" " * len(_APART) + bytes(range(97, 123)))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in turn, as UTF-8. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds for each unit of a term's weight, in a document of length measure m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_measures(n: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L of documents with n terms, whatever the size of the product."""
    return np.array([25 + 75 * int(x) * total_docs // max(1, total_terms) for x in n], dtype=np.int64)


def term_weight(df: int, total_docs: int) -> int:
    return math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1)))


def exact_parts(weights: np.ndarray) -> list[np.ndarray]:
    """Matrices of whole doubles that add up to the weights, each with row sums below EXACT / IMPACT.

    The product of one of them with impacts has no partial sum of EXACT or more, in whatever order BLAS adds.
    """
    room = EXACT // IMPACT - weights.shape[1]  # each entry is rounded up by less than one
    n = -(-int(weights.sum(axis=1).max(initial=0)) // room) or 1
    return [((weights + i) // n).astype(np.float64) for i in range(n)]


def product(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """weights @ found for whole numbers, by BLAS in doubles, a block of TILE_TERMS columns at a time."""
    out = np.zeros((weights.shape[0], found.shape[1]), dtype=np.int64)
    for at in range(0, weights.shape[1], TILE_TERMS):
        block = found[at : at + TILE_TERMS].astype(np.float64)
        for part in exact_parts(weights[:, at : at + TILE_TERMS]):
            out += (part @ block).astype(np.int64)
    return out


class Best:
    """The k best (score, doc_id) of each item so far. Equal scores go by doc_id, a null one last."""

    def __init__(self, items: int, k: int):
        self.items, self.k = items, k
        self.rows: list[np.ndarray] = [np.empty((4, 0), dtype=np.int64)]  # item, score, no id, id
        self.held = 0

    def add(self, first: int, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        """scores: an item a row, a document a column; columns are in order of (no_id, ids)."""
        keep = scores > 0
        n = scores.shape[1]
        if n > self.k:
            cut = np.partition(scores, n - self.k, axis=1)[:, n - self.k, None]
            above, tied = scores > cut, scores == cut
            room = self.k - above.sum(axis=1, keepdims=True)
            keep &= above | tied & (np.cumsum(tied, axis=1) <= room)
        item, col = np.nonzero(keep)
        self.rows.append(np.stack([item + first, scores[item, col], no_id[col], ids[col]]))
        self.held += len(item)
        if self.held > 8 * self.k * self.items:
            self.cut()

    def cut(self) -> np.ndarray:
        found = np.concatenate(self.rows, axis=1)
        item, score, no_id, ids = found
        found = found[:, np.lexsort((ids, no_id, -score, item))]
        starts = np.flatnonzero(np.diff(found[0], prepend=-1))
        place = np.arange(found.shape[1]) - np.repeat(starts, np.diff(np.append(starts, found.shape[1])))
        found = found[:, place < self.k]
        self.rows, self.held = [found], found.shape[1]
        return found


def _sparse(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, codes, tfs): a document's number of terms, and those of the vocabulary with their counts."""
    size, shared = len(vocabulary), docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = shared.value.get
        lengths, codes = [], []
        for text in batch.column(1).to_pylist():
            words = terms(text)
            lengths.append(len(words))
            codes.append(np.array([c for c in map(code, words) if c is not None], dtype=np.int64))
        row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        pairs, tfs = np.unique(row * size + np.concatenate(codes), return_counts=True)
        ends = pa.array(spans(np.bincount(pairs // size, minlength=len(codes))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % size, tfs)]
        columns = [batch.column(0), pa.array(lengths, pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "codes", "tfs"])

    return arrow_pass(docs, count, "doc_id long, n long, codes array<int>, tfs array<int>")


def _tile_hits(sparse: DataFrame, weights: list[np.ndarray], vocabularies: list[np.ndarray], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best of every task for each item.

    weights: of a tile of items each (an item a row, a term of the tile a column), vocabularies: the codes of the
    columns. Only the columns of terms that stand in a tile of documents are multiplied.
    """
    shared = sparse.sparkSession.sparkContext.broadcast((weights, vocabularies))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, columns = shared.value
        best = Best(sum(map(len, tiles)), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(at, TILE_DOCS)
                no_id = pc.is_null(part.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                codes, tfs = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)
                m = length_measures(part.column(1).to_numpy(zero_copy_only=False), n_docs, n_terms)
                values = impacts(tfs, np.repeat(m, sizes))
                order = np.lexsort((ids, no_id))
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                doc = np.repeat(place, sizes)
                seen = np.unique(codes)
                first = 0
                for tile, vocabulary in zip(tiles, columns):
                    both, here, _ = np.intersect1d(vocabulary, seen, assume_unique=True, return_indices=True)
                    if len(both):
                        slot = np.searchsorted(both, codes)
                        mine = both[np.minimum(slot, len(both) - 1)] == codes
                        found = np.zeros((len(both), len(order)))
                        found[slot[mine], doc[mine]] = values[mine]
                        best.add(first, product(tile[:, here], found), no_id[order], ids[order])
                    first += len(tile)
        item, score, no_id, ids = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids, mask=no_id.astype(bool)), pa.array(score)], ["item", "doc_id", "score"]
        )

    return sparse.mapInArrow(search, "item long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item; ties by doc_id.

    Items are taken in passes of about TILE_BYTES of their texts. A pass reads the documents once: each becomes
    its terms that any item of the pass has, with counts, in a written table; from that come the document
    frequencies. Then weights of TILE_ITEMS items, over the compact vocabulary of just these, are multiplied
    with the impacts of TILE_DOCS documents in doubles. No partial sum reaches 2^53, so products are exact. A
    task keeps the k best of each item; the rest of the merge is a ranked window.

    What is broadcast are the items of one pass: their vocabulary and their weights, bounded by TILE_BYTES of
    text (or one longer item), however many items and documents there are.

    Null and empty texts have no terms: such documents are found for no item and don't count, such items find
    nothing. A repeated document takes a rank for each of its rows, and repeated items are answered as often as
    they come. Null doc_ids stand behind all others among equal scores. Empty tables give an empty result.
    Further columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked")
    docs = id_and_text(docs, id_col, text_col)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = asked.withColumn("_key", F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    asked = running_sum(asked, [F.col("_key")], size, "_at", scratch)
    asked = scratch.keep(asked.withColumn("_pass", F.floor(F.col("_at") / TILE_BYTES)))
    passes = [r[0] for r in asked.select("_pass").distinct().orderBy("_pass").collect()]  # one number for each TILE_BYTES
    found = None
    for number in passes:
        rows = asked.where(F.col("_pass") == number).orderBy("_at").collect()  # TILE_BYTES of text, or one item
        hits = _pass_hits(docs, [terms(r["text"]) for r in rows], k, scratch)
        names = spark.createDataFrame([(i, r["item_id"], r["_at"]) for i, r in enumerate(rows)], "item long, item_id long, _item long")
        hits = hits.join(F.broadcast(names), "item").drop("item")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def _pass_hits(docs: DataFrame, asked: list[list[bytes]], k: int, scratch: Scratch) -> DataFrame:
    """(item, doc_id, score) of the items of one pass, the k best of every task."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for words in asked for t in words}))}
    sparse = scratch.keep(_sparse(docs, vocabulary))
    total = sparse.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = sparse.select(F.explode("codes").alias("code")).groupBy("code").count().collect()  # the vocabulary's size
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    for code, df in counted:
        weight[code] = term_weight(df, total[0])
    weights, vocabularies = [], []
    for at in range(0, len(asked), TILE_ITEMS):
        tile = [np.array([vocabulary[t] for t in words], dtype=np.int64) for words in asked[at : at + TILE_ITEMS]]
        columns, where = np.unique(np.concatenate(tile), return_inverse=True)
        row = np.repeat(np.arange(len(tile)), [len(x) for x in tile])
        matrix = np.bincount(row * len(columns) + where, minlength=len(tile) * len(columns)) if len(where) else np.zeros(0, dtype=np.int64)
        weights.append(matrix.reshape(len(tile), -1) * weight[columns])
        vocabularies.append(columns)
    return _tile_hits(sparse, weights, vocabularies, *total, k)
