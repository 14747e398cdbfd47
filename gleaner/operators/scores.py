"""Query-passage scores over a table of candidate pairs (q_id, p_id)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gleaner.operators.cells import empty_like, parallelism
from gleaner.operators.skew import HOT_ROWS, skew_join
from gleaner.session import new_path
from gleaner.sources.tables import table_roundtrip

PAIR = ["q_id", "p_id"]
TEMPERATURE = 1.0
TOKEN_BLOCK = 512  # token vectors in one row
MAP_TOKENS = 20_000  # tokens in one list, about
CELL_BYTES = 128 << 20  # lists of a cell of pairs, counted anew for each pair
ENTRY_BYTES = 16  # a code and a weight in a list
HOT_PAIRS = HOT_ROWS // 100  # pairs of one document that a task may take, each with its token vectors


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def score_dense(
    q: DataFrame, p: DataFrame, pairs: DataFrame, id: str = "id", vec: str = "vec",
    temperature: float = TEMPERATURE, name: str = "dense",
) -> DataFrame:
    """Inner product of the two vectors of every pair, divided by the temperature."""
    pairs = pairs.select(*PAIR)
    sided = skew_join(pairs, _renamed(q, q_id=id, _qv=vec), ["q_id"], "inner", ["p_id"])
    sided = skew_join(sided, _renamed(p, p_id=id, _pv=vec), ["p_id"], "inner", ["q_id"], sized_by=pairs)
    products = F.arrow_udf(_products, "double")
    return sided.select(*PAIR, (products("_qv", "_pv") / temperature).alias(name))


def _products(q: pa.Array, p: pa.Array) -> pa.Array:
    """Inner product of each row's two vectors, null where one is missing; a row's vectors have one length."""
    both = pc.and_(q.is_valid(), p.is_valid())
    at = np.flatnonzero(both.to_numpy(zero_copy_only=False))
    q, p = q.take(pa.array(at)), p.take(pa.array(at))
    qv, pv = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for x in (q, p))
    if len(qv) != len(pv):
        raise ValueError("vectors of a pair differ in length")
    out, sizes = np.zeros(len(at)), np.diff(q.offsets.to_numpy())
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(qv * pv, (q.offsets.to_numpy()[:-1] - q.offsets[0].as_py())[some])
    full = np.full(len(both), np.nan)
    full[at] = out
    return pa.array(full, mask=~both.to_numpy(zero_copy_only=False))


def score_attention(
    q: DataFrame, p: DataFrame, pairs: DataFrame, id: str = "id", q_vec: str = "attended",
    p_vec: str = "vec", temperature: float = TEMPERATURE,
) -> DataFrame:
    """As score_dense over attended vectors: of the query only, or of both sides, by choice of columns."""
    return score_dense(
        _renamed(q, id=id, vec=q_vec), _renamed(p, id=id, vec=p_vec), pairs,
        temperature=temperature, name="attention",
    )


def lexical_weights(
    tokens: DataFrame, special: Sequence[str] = (), doc: str = "doc_id", token: str = "token",
    weight: str = "weight",
) -> DataFrame:
    """max(0, weight) per (document, token); the largest where a token repeats; no special tokens."""
    kept = tokens.where(~F.col(token).isin(list(special))) if special else tokens
    return kept.groupBy(doc, token).agg(F.max(F.greatest(F.col(weight), F.lit(0.0))).alias(weight))


def _sizes(weights: DataFrame) -> DataFrame:
    """(_id, _n, _odd): tokens of each document, and whether a weight of it is null or not finite."""
    w = F.col("_w").cast("double")
    odd = F.coalesce(F.isnan(w) | (F.abs(w) == float("inf")), F.lit(True))
    return weights.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd"))


def _large(sizes: DataFrame) -> DataFrame:
    """(_id, _bits): documents of more than MAP_TOKENS tokens, whose lists are cut in 2^_bits parts."""
    bits = F.ceil(F.log2(F.col("_n") / MAP_TOKENS)).cast("int").alias("_bits")
    return sizes.where(F.col("_n") > MAP_TOKENS).select("_id", bits)


def _part(value: Column, bits: Column) -> Column:
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")


def _token_lists(weights: DataFrame, large: DataFrame | None, side: str) -> DataFrame:
    """(<side>_id, _<side>p, _<side>w): every document's codes and weights, packed; a large one's in parts by code."""
    part = F.lit(0).alias(f"_{side}p")
    if large is not None:
        weights = skew_join(weights, large, ["_id"], "left", ["_t"])
        part = _part(F.xxhash64("_t"), F.coalesce("_bits", F.lit(0))).alias(f"_{side}p")
    entry = F.struct(F.xxhash64("_t").alias("code"), F.col("_w").cast("double").alias("weight"))
    lists = weights.groupBy(F.col("_id").alias(f"{side}_id"), part).agg(F.collect_list(entry).alias("_l"))
    pack = F.arrow_udf(_packed, "binary")
    return lists.select(f"{side}_id", f"_{side}p", pack("_l").alias(f"_{side}w"))


def _packed(lists: pa.Array) -> pa.Array:
    """The (code, weight) of each row in order of code: all codes, then all weights. Pairs then move them as one value."""
    starts = lists.offsets.to_numpy()
    codes, weights = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        order = np.argsort(codes[a:b], kind="stable")
        out.append(codes[a:b][order].tobytes() + weights[a:b][order].tobytes())
    return pa.array(out, pa.binary())


def _shared_products(q: pa.Array, p: pa.Array) -> pa.Array:
    """Per row the sum over codes in both packed lists of the product of their weights; 0 where one is missing."""
    return pa.array([_shared_product(left.as_buffer(), right.as_buffer()) for left, right in zip(q, p)], pa.float64())


def _shared_product(left: pa.Buffer | None, right: pa.Buffer | None) -> float:
    if left is None or right is None:
        return 0.0
    (a, x), (b, y) = _unpacked(left), _unpacked(right)
    if len(a) > len(b):
        a, b, x, y = b, a, y, x
    if not len(a):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(np.dot(x, np.where(b[at] == a, y[at], 0.0)))


def _unpacked(packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n = packed.size // 16
    return np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.float64, n, 8 * n)


def _written(df: DataFrame, name: str) -> DataFrame:
    return table_roundtrip(df, new_path(df.sparkSession, name))


def _celled(pairs: DataFrame, q_sizes: DataFrame, p_sizes: DataFrame) -> DataFrame:
    """The pairs with a _cell: runs of them in order of q_id, whose lists come to CELL_BYTES at most for each cell."""
    q_n, p_n = (_renamed(s, **{f"{side}_id": "_id", f"_{side}n": "_n"}) for s, side in ((q_sizes, "q"), (p_sizes, "p")))
    sided = skew_join(pairs, q_n, ["q_id"], "left", ["p_id"])
    sided = skew_join(sided, p_n, ["p_id"], "left", ["q_id"], sized_by=pairs)
    size = ENTRY_BYTES * (F.coalesce("_qn", F.lit(0)) + F.coalesce("_pn", F.lit(0)) + 1)
    ranged = sided.select(*PAIR, size.alias("_size")).repartitionByRange(*PAIR)
    ranged = _written(ranged.withColumn("_part", F.spark_partition_id().cast("long")), "pairs")
    total = ranged.agg(F.sum("_size")).first()[0] or 0
    most = max(1, min(CELL_BYTES, total // (4 * parallelism(pairs))))  # enough cells for the workers
    until = Window.partitionBy("_part").orderBy(*PAIR).rowsBetween(Window.unboundedPreceding, 0)
    run = F.floor((F.sum("_size").over(until) - F.col("_size")) / most)
    return ranged.select(*PAIR, (F.col("_part") * 2**32 + run).alias("_cell"))


def _lexical_in_cells(
    pairs: DataFrame, qw: DataFrame, pw: DataFrame, q_sizes: DataFrame, p_sizes: DataFrame
) -> DataFrame:
    """(q_id, p_id, lexical) of pairs of documents of MAP_TOKENS tokens at most, not yet divided by the temperature.

    A list goes once to each cell that has a pair of its document, not once to each pair; so no more is moved than
    by a join of pairs and lists, and much less where pairs with near q_ids share passages or are one another's.
    """
    celled = _written(_celled(pairs, q_sizes, p_sizes), "cells")
    one = qw is pw
    sides = [("q", qw, PAIR)] if one else [("q", qw, PAIR[:1]), ("p", pw, PAIR[1:])]
    streams = []
    for at, (side, weights, ids) in enumerate(sides):
        needed = celled.select("_cell", F.explode(F.array(*ids)).alias(f"{side}_id")).distinct()
        # A document is in no more rows of these than there are cells.
        lists = needed.join(_token_lists(weights, None, side).drop(f"_{side}p"), f"{side}_id")
        own = [F.col(f"{side}_id").alias(c) if c in ids else F.lit(None).alias(c) for c in PAIR]
        streams.append(lists.select("_cell", F.lit(at).alias("_turn"), *own, F.col(f"_{side}w").alias("_w")))
    streams.append(celled.select("_cell", F.lit(2).alias("_turn"), *PAIR, F.lit(None).cast("binary").alias("_w")))
    types = pairs.schema
    schema = T.StructType([types["q_id"], types["p_id"], T.StructField("lexical", T.DoubleType())])
    streams = [s.select("_cell", "_turn", *[F.col(c).cast(types[c].dataType) for c in PAIR], "_w") for s in streams]
    names = empty_like(schema).schema

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[dict] = [{}, {}]
        of_q, of_p = lists[0], lists[0 if one else 1]
        for batch in batches:
            turns = batch.column("_turn").to_numpy()
            own = [batch.column(c).to_pylist() for c in PAIR]
            first = int(np.searchsorted(turns, 2))
            for i, packed in enumerate(batch.column("_w").slice(0, first)):
                lists[turns[i]][own[turns[i]][i]] = packed.as_buffer()
            found = [_shared_product(of_q.get(a), of_p.get(b)) for a, b in zip(own[0][first:], own[1][first:])]
            columns = [batch.column(c).slice(first) for c in PAIR] + [pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=names)

    stream = streams[0]
    for other in streams[1:]:
        stream = stream.unionByName(other)
    stream = stream.repartition("_cell").sortWithinPartitions("_cell", "_turn")
    return stream.groupBy("_cell").applyInArrow(products, schema)


def score_lexical(
    q: DataFrame, p: DataFrame, pairs: DataFrame, id: str = "doc_id", token: str = "token",
    weight: str = "weight", temperature: float = TEMPERATURE,
) -> DataFrame:
    """Sum over shared tokens of the product of both weights; 0 for a pair that shares none.

    A token stands once per document, as lexical_weights leaves it. Work starts from the pairs, so a token
    all documents share costs no more than any other. Pairs are put in cells in order of q_id, and a cell gets the
    list of each of its documents once: sorted token codes (64-bit hashes) and weights, which are merged in Arrow.
    Weights of zero are left out of the lists, unless a weight is null or not finite. The list of a document with more
    than MAP_TOKENS tokens is cut in parts by code, and only the pairs it is in come in as many rows.
    """
    pairs = pairs.select(*PAIR)
    products = F.arrow_udf(_shared_products, "double")
    qw = _renamed(q, _id=id, _t=token, _w=weight)
    pw = qw if p is q else _renamed(p, _id=id, _t=token, _w=weight)
    q_sizes = _written(_sizes(qw), "sizes")
    p_sizes = q_sizes if p is q else _written(_sizes(pw), "sizes")
    if q_sizes.where("_odd").isEmpty() and (p is q or p_sizes.where("_odd").isEmpty()):
        qw = qw.where("_w != 0")
        pw = qw if p is q else pw.where("_w != 0")
    q_large, p_large = _large(q_sizes), _large(p_sizes)
    some = not q_large.isEmpty() or (p is not q and not p_large.isEmpty())
    if not some:
        found = _lexical_in_cells(pairs, qw, pw, q_sizes, p_sizes)
        return found.select(*PAIR, (F.col("lexical") / temperature).alias("lexical"))
    sided = skew_join(pairs, _renamed(q_large, q_id="_id", _qb="_bits"), ["q_id"], "left", ["p_id"])
    sided = skew_join(sided, _renamed(p_large, p_id="_id", _pb="_bits"), ["p_id"], "left", ["q_id"], sized_by=pairs)
    sided = _written(sided, "pairs")
    uncut = sided.where("_qb IS NULL AND _pb IS NULL").select(*PAIR)
    small = [w.join(l, "_id", "left_anti") for w, l in ((qw, q_large), (pw, p_large))]
    whole = _lexical_in_cells(uncut, small[0], small[0] if p is q else small[1], q_sizes, p_sizes)
    whole = whole.select(*PAIR, (F.col("lexical") / temperature).alias("lexical"))
    sided = sided.where("_qb IS NOT NULL OR _pb IS NOT NULL")
    cut_pairs = sided.select(*PAIR)
    q_bits, p_bits = (F.coalesce(c, F.lit(0)) for c in ("_qb", "_pb"))
    parts = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(q_bits, p_bits))
    part = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    sided = sided.select(*PAIR, q_bits.alias("_qb"), p_bits.alias("_pb"), part.alias("_j"))
    sided = sided.withColumn("_qp", _part(F.col("_j"), F.col("_qb"))).withColumn("_pp", _part(F.col("_j"), F.col("_pb")))
    sided = sided.drop("_qb", "_pb")
    # A (document, part) key is as hot as its document is among the pairs.
    sided = skew_join(
        sided, _token_lists(qw, q_large, "q"), ["q_id", "_qp"], "left", ["p_id"], sized_by=cut_pairs, hot_on=["q_id"]
    )
    sided = skew_join(
        sided, _token_lists(pw, p_large, "p"), ["p_id", "_pp"], "left", ["q_id"], sized_by=cut_pairs, hot_on=["p_id"]
    )
    scored = sided.select(*PAIR, (products("_qw", "_pw") / temperature).alias("lexical"))
    return whole.unionByName(scored.groupBy(*PAIR).agg(F.sum("lexical").alias("lexical")))


def _token_blocks(tokens: DataFrame, side: str) -> DataFrame:
    """(<side>_id, _<side>c, _<side>v): the vectors of up to TOKEN_BLOCK tokens of a document, end to end."""
    block = F.floor(F.col("_pos") / TOKEN_BLOCK).alias(f"_{side}c")
    in_order = F.array_sort(F.collect_list(F.struct("_pos", "_vec")))
    vectors = F.flatten(F.transform(in_order, lambda s: s["_vec"]))
    return tokens.groupBy(F.col("_id").alias(f"{side}_id"), block).agg(
        vectors.alias(f"_{side}v"), F.count(F.lit(1)).alias(f"_{side}n")
    )


def _best_products(q: pa.Array, n: pa.Array, p: pa.Array) -> pa.Array:
    """Per row: for each of n query vectors the largest inner product with any passage vector."""
    q_at, p_at = q.offsets.to_numpy(), p.offsets.to_numpy()
    q_all = q.values.to_numpy(zero_copy_only=False).astype(np.float64)
    p_all = p.values.to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for i, count in enumerate(n.to_pylist()):
        qm, pm = q_all[q_at[i] : q_at[i + 1]], p_all[p_at[i] : p_at[i + 1]]
        if not len(qm) or not len(pm):
            out.append(None)
            continue
        qm = qm.reshape(count, -1)
        out.append((qm @ pm.reshape(-1, qm.shape[1]).T).max(axis=1))
    return pa.array(out, pa.list_(pa.float64()))


def score_maxsim(
    q_tok: DataFrame, p_tok: DataFrame, pairs: DataFrame, id: str = "doc_id", pos: str = "pos",
    vec: str = "vec", temperature: float = TEMPERATURE,
) -> DataFrame:
    """Mean over the query's tokens of the best inner product with any passage token.

    The first token (position 0) of either side is left out; a pair that then lacks tokens scores NULL.
    A pair meets the token vectors of both documents in one row and one small matrix product. Documents
    with more than TOKEN_BLOCK tokens come in blocks, whose maxima are merged.
    """
    pairs = pairs.select(*PAIR)
    qt, pt = (_renamed(t, _id=id, _pos=pos, _vec=vec).where("_pos > 0") for t in (q_tok, p_tok))
    longest = max(t.agg(F.max("_pos")).first()[0] or 0 for t in (qt, pt))
    sided = skew_join(pairs, _token_blocks(qt, "q"), ["q_id"], "left", ["p_id"], hot_rows=HOT_PAIRS)
    sided = skew_join(
        sided, _token_blocks(pt, "p"), ["p_id"], "left", ["q_id"], sized_by=pairs, hot_rows=HOT_PAIRS
    )
    best_products = F.arrow_udf(_best_products, "array<double>")
    best = sided.select(*PAIR, "_qc", best_products("_qv", "_qn", "_pv").alias("_best"))
    if longest < TOKEN_BLOCK:  # one block per document
        total = F.aggregate("_best", F.lit(0.0), lambda a, x: a + x)
        return best.select(*PAIR, (total / F.size("_best") / temperature).alias("maxsim"))
    tokens = best.select(*PAIR, "_qc", F.posexplode_outer("_best").alias("_at", "_best"))
    merged = tokens.groupBy(*PAIR, "_qc", "_at").agg(F.max("_best").alias("_best"))
    return merged.groupBy(*PAIR).agg((F.avg("_best") / temperature).alias("maxsim"))


def score_ensemble(
    dense: DataFrame | None,
    lexical: DataFrame | None,
    maxsim: DataFrame | None,
    attention: DataFrame | None = None,
    weights: Sequence[float] = (1.0, 0.3, 1.0, 0.3),
    with_attention: bool = True,
) -> DataFrame:
    """Weighted sum of the score tables of the same pairs, beside the parts. A part that is not there is an error."""
    parts = [("dense", dense), ("lexical", lexical), ("maxsim", maxsim)]
    if with_attention:
        parts.append(("attention", attention))
    absent = [name for name, df in parts if df is None]
    if absent:
        raise ValueError("scores must be provided: " + ", ".join(absent))
    joined = parts[0][1].select(*PAIR, "dense")
    for name, df in parts[1:]:
        joined = joined.join(df.select(*PAIR, name), PAIR, "full")
    total = sum((F.col(name) * w for (name, _), w in zip(parts, weights)), F.lit(0.0))
    lacking = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name, _ in parts]))
    checked = F.when(
        F.size(lacking) > 0,
        F.raise_error(F.concat(F.lit("a pair lacks scores: "), F.array_join(lacking, ", "))).cast("double"),
    ).otherwise(total)
    return joined.select(*PAIR, *[name for name, _ in parts], checked.alias("ensemble"))
