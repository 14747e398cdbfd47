"""Pooling, and softmax-weighted sums over the rows of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleaner.operators.aggregates import first_by, log_sum_exp, vector_mean, vector_sum
from gleaner.operators.cells import batch_block_rows, batch_cells, matrix, slabs, vector_dim


def pool_cls(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """The vector of each document's first token."""
    return first_by(tokens.select(doc, pos, vec), doc, pos).drop(pos)


def pool_last(
    tokens: DataFrame, doc: str = "doc_id", pos: str = "pos", vec: str = "vec", mask: str | None = None
) -> DataFrame:
    """The vector of each document's last valid token."""
    return first_by(_valid(tokens, mask).select(doc, pos, vec), doc, pos, last=True).drop(pos)


def pool_mean(tokens: DataFrame, doc: str = "doc_id", vec: str = "vec", mask: str | None = None) -> DataFrame:
    """The mean vector of each document's valid tokens."""
    return vector_mean(_valid(tokens, mask), [doc], vec)


def _valid(tokens: DataFrame, mask: str | None) -> DataFrame:
    return tokens.where(F.col(mask) == 1) if mask else tokens


def _id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType)


def batch_lse(
    left: DataFrame, right: DataFrame, batch: str, id_col: str, l_vec: str, r_vec: str,
    scale: float = 1.0, rows: int | None = None,
) -> DataFrame:
    """(batch, id, lse): log-sum-exp of scale * inner product with every right row of the batch.

    Cells hand back one number per left row, so the score matrix of a batch is never written out.
    """
    rows = rows or batch_block_rows(vector_dim(left, l_vec))
    schema = T.StructType([_id_field(left, batch), _id_field(left, id_col), T.StructField("_lse", T.DoubleType())])

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        lm, rm = matrix(lt, l_vec), matrix(rt, r_vec)
        out = []
        for part in slabs(len(lm), len(rm)):
            s = scale * (lm[part] @ rm.T)
            top = s.max(axis=1)
            out.append(top + np.log(np.exp(s - top[:, None]).sum(axis=1)))
        return pa.table({batch: lt.column(batch), id_col: lt.column(id_col), "_lse": np.concatenate(out)})

    cells = batch_cells(
        left.select(batch, id_col, l_vec), right.select(batch, id_col, r_vec), batch, id_col, kernel, schema, rows
    )
    return log_sum_exp(cells, [batch, id_col], "_lse", "lse")


def _weighted_sums(
    left: DataFrame, right: DataFrame, batch: str, id_col: str, l_vec: str, r_vec: str, value: str,
    scale: float, lse_on_left: bool, out: str, rows: int,
) -> DataFrame:
    """Per left row, the sum over right rows of exp(scale * product - lse) * value."""
    schema = T.StructType(
        [_id_field(left, batch), _id_field(left, id_col), T.StructField(out, T.ArrayType(T.DoubleType()))]
    )

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        lm, rm, vm = matrix(lt, l_vec), matrix(rt, r_vec), matrix(rt, value)
        lse = (lt if lse_on_left else rt).column("lse").to_numpy()
        sums = np.empty((len(lm), vm.shape[1]))
        for part in slabs(len(lm), len(rm)):
            shift = lse[part][:, None] if lse_on_left else lse[None, :]
            sums[part] = np.exp(scale * (lm[part] @ rm.T) - shift) @ vm
        offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * vm.shape[1])
        vectors = pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))
        return pa.table({batch: lt.column(batch), id_col: lt.column(id_col), out: vectors})

    # One side carries normalisers; the other has the same rows without them, so it is the one to count.
    plain = right if lse_on_left else left
    cells = batch_cells(left, right, batch, id_col, kernel, schema, rows, sized_by=plain.select(batch))
    return vector_sum(cells, [batch, id_col], out)


def category_vectors(
    df: DataFrame, batch: str, id_col: str = "id", vec: str = "vec", out: str = "category",
    rows: int | None = None,
) -> DataFrame:
    """category_i = sum_j W[i,j] e_j, W the softmax of E E^T over its first index, inside each batch."""
    rows = rows or batch_block_rows(vector_dim(df, vec))
    base = df.select(batch, id_col, vec)
    # The products are symmetric, so a column's normaliser is the row's of the same id.
    lse = batch_lse(base, base, batch, id_col, vec, vec, 1.0, rows)
    right = base.join(lse, [batch, id_col])
    return _weighted_sums(base, right, batch, id_col, vec, vec, vec, 1.0, False, out, rows)


def self_attention_vectors(
    df: DataFrame, batch: str, id_col: str = "id", q: str = "q", k: str = "k", v: str = "v",
    out: str = "attended", heads: int = 1, rows: int | None = None,
) -> DataFrame:
    """softmax(q k^T / sqrt(d)) v over the rows of each batch; d is the length of one head's slice."""
    dim = vector_dim(df, q)
    if dim % heads:
        raise ValueError(f"{dim} elements do not split in {heads} heads")
    depth = dim // heads
    rows = rows or batch_block_rows(depth)
    head = F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("_head")
    sliced = df.select(batch, id_col, q, k, v, head)
    for name in (q, k, v):
        sliced = sliced.withColumn(name, F.slice(name, F.col("_head") * depth + 1, F.lit(depth)))
    group = F.struct(batch, "_head") if heads > 1 else F.col(batch)
    base = sliced.withColumn("_group", group.cast("string") if heads > 1 else group)
    lse = batch_lse(base, base, "_group", id_col, q, k, depth ** -0.5, rows)
    left = base.select("_group", id_col, q).join(lse, ["_group", id_col])
    right = base.select("_group", id_col, k, v)
    sums = _weighted_sums(left, right, "_group", id_col, q, k, v, depth ** -0.5, True, out, rows)
    if heads == 1:
        return sums.withColumnRenamed("_group", batch)
    names = base.select("_group", id_col, batch, "_head")
    parts = sums.join(names, ["_group", id_col]).groupBy(batch, id_col)
    by_head = F.array_sort(F.collect_list(F.struct("_head", out)))  # one entry per head
    return parts.agg(F.flatten(F.transform(by_head, lambda p: p[out])).alias(out))
