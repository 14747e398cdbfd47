"""Softmax targets, contrastive and distillation losses over score tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleaner.functions.vectors import dot
from gleaner.operators.aggregates import log_sum_exp
from gleaner.operators.attention import batch_lse
from gleaner.operators.cells import batch_cells, matrix, slabs
from gleaner.operators.skew import skew_join

# Weights of the parts and divisors, per model variant.
BLENDS = {
    "base": {"parts": {"dense": 1.0, "ensemble": 1.0, "lexical": 0.1, "maxsim": 1.0}, "over": 4, "distill_over": 3},
    "attention": {
        "parts": {"dense": 1.0, "ensemble": 1.0, "lexical": 0.1, "maxsim": 1.0, "attention": 0.1},
        "over": 5,
        "distill_over": 4,
    },
    "category": {
        "parts": {"dense": 1.0, "ensemble": 1.0, "lexical": 0.1, "maxsim": 1.0, "category": 1.0},
        "over": 5,
        "distill_over": 4,
    },
}


def teacher_softmax(
    df: DataFrame, group: str, score: str = "score", key: str | None = None, out: str = "target"
) -> DataFrame:
    """Softmax of the teacher scores inside each group, for groups of any size."""
    lse = log_sum_exp(df, [group], score, "_lse")
    spread = [key] if key else None
    joined = skew_join(df, lse, [group], "inner", spread)
    return joined.withColumn(out, F.exp(F.col(score) - F.col("_lse"))).drop("_lse")


def query_losses(scores: DataFrame, group: str, score: str = "score", target: str = "is_target") -> DataFrame:
    """(group, loss): cross entropy of one query, its own passages being the candidates."""
    hit = F.when(F.col(target), F.col(score))
    sums = log_sum_exp(scores, [group], score, "_lse", also=[hit])
    return sums.select(group, (F.col("_lse") - F.col("_x0")).alias("loss"))


def contrastive_loss(scores: DataFrame, group: str, score: str = "score", target: str = "is_target") -> DataFrame:
    """Mean cross entropy of a score table; the target is the group's positive."""
    return query_losses(scores, group, score, target).agg(F.avg("loss").alias("loss"))


def in_batch_loss(
    q: DataFrame, p: DataFrame, batch: str, id_col: str = "id", vec: str = "vec", target: str = "is_target",
    temperature: float = 1.0, rows: int | None = None,
) -> DataFrame:
    """Mean cross entropy with every passage of the batch as a candidate.

    q has (batch, id, vec); p has the same columns plus group, the id of the query the passage belongs to,
    and the flag of its positive. The scores of a batch are summed block by block, never written out.
    """
    lse = batch_lse(q, p, batch, id_col, vec, vec, 1.0 / temperature, rows)
    own = p.where(F.col(target)).select(batch, F.col("group").alias(id_col), F.col(vec).alias("_pv"))
    hit = q.select(batch, id_col, vec).join(own, [batch, id_col])
    loss = F.col("lse") - dot(vec, "_pv") / temperature
    return hit.join(lse, [batch, id_col]).agg(F.avg(loss).alias("loss"))


def _dense_block(lt: pa.Table, rt: pa.Table, part: slice) -> np.ndarray:
    return matrix(lt.slice(part.start, part.stop - part.start), "dense") @ matrix(rt, "dense").T


def _attention_block(lt: pa.Table, rt: pa.Table, part: slice) -> np.ndarray:
    return matrix(lt.slice(part.start, part.stop - part.start), "attention") @ matrix(rt, "attention").T


def _maxsim_block(lt: pa.Table, rt: pa.Table, part: slice) -> np.ndarray:
    """Mean over a query's tokens of the best product with any token of a passage; token vectors end to end."""
    dim = lt.column("token_dim")[0].as_py()
    left = lt.column("tokens").slice(part.start, part.stop - part.start).combine_chunks()
    right = rt.column("tokens").combine_chunks()
    lm, rm = (x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for x in (left, right))
    sizes = [np.diff(x.offsets.to_numpy()) // dim for x in (left, right)]
    starts = [np.concatenate([[0], np.cumsum(n)[:-1]]) for n in sizes]
    out = np.empty((len(sizes[0]), len(sizes[1])))
    for i, (at, n) in enumerate(zip(starts[0], sizes[0])):
        best = np.maximum.reduceat(lm[at : at + n] @ rm.T, starts[1], axis=1)
        out[i] = best.mean(axis=0)
    return out


def _lexical_block(lt: pa.Table, rt: pa.Table, part: slice) -> np.ndarray:
    """Sums over shared tokens, a stretch of the block's vocabulary at a time."""
    sides = [lt.slice(part.start, part.stop - part.start), rt]
    entries = []
    for side in sides:
        lists = side.column("lexical").combine_chunks()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        entries.append((owner, flat.field("token"), flat.field("weight").to_numpy(zero_copy_only=False)))
    coded = pa.concat_arrays([e[1] for e in entries]).dictionary_encode().indices.to_numpy()
    n_left = len(entries[0][0])
    codes = coded[:n_left], coded[n_left:]
    out = np.zeros((len(sides[0]), len(sides[1])))
    for at in range(0, int(coded.max(initial=-1)) + 1, VOCABULARY):
        dense = []
        for (owner, _, weight), code, side in zip(entries, codes, sides):
            here = (code >= at) & (code < at + VOCABULARY)
            block = np.zeros((len(side), VOCABULARY))
            block[owner[here], code[here] - at] = weight[here]
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


BLOCKS = {"dense": _dense_block, "lexical": _lexical_block, "maxsim": _maxsim_block, "attention": _attention_block}
VOCABULARY = 4096  # tokens of a block's vocabulary that are multiplied at once


def in_batch_losses(
    q: DataFrame, p: DataFrame, batch: str, parts: Sequence[str] = ("dense", "lexical", "maxsim"),
    weights: dict[str, float] | None = None, temperature: float = 1.0, id_col: str = "id", target: str = "is_target",
    rows: int = 512,
) -> DataFrame:
    """One row: the mean cross entropy of each score, with every passage of the batch as a candidate.

    q and p have (batch, id) and, for the parts asked for, dense and attention (vectors; the query's attended),
    tokens (token vectors end to end, their length in token_dim, first tokens left out, one at least) and
    lexical (array of (token, weight)). p also has group, the id of the query a passage belongs to, and the
    flag of its positive, of which a query has one. With weights the weighted sum of the parts is a further
    score, ensemble. Block by block of a batch all scores are made together; a task hands back two numbers
    for each query and score, never a score.
    """
    names = [*parts, *(["ensemble"] if weights else [])]
    id_type = q.schema[id_col].dataType
    fields = [T.StructField(batch, q.schema[batch].dataType), T.StructField(id_col, id_type)]
    fields += [T.StructField(f"{kind}_{n}", T.DoubleType()) for n in names for kind in ("lse", "hit")]
    schema = T.StructType(fields)
    columns = {"dense": ["dense"], "attention": ["attention"], "lexical": ["lexical"], "maxsim": ["tokens", "token_dim"]}
    needed = [c for n in parts for c in columns[n]]

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found: dict[str, list] = {f"{kind}_{n}": [] for n in names for kind in ("lse", "hit")}
        own = {g: i for i, (g, hit) in enumerate(zip(rt.column("group").to_pylist(), rt.column(target).to_pylist())) if hit}
        at = np.array([own.get(i, -1) for i in lt.column(id_col).to_pylist()])
        for part in slabs(lt.num_rows, rt.num_rows):
            part = slice(part.start, min(part.stop, lt.num_rows))
            scores = {n: BLOCKS[n](lt, rt, part) / temperature for n in parts}
            if weights:
                scores["ensemble"] = sum(scores[n] * weights[n] for n in parts)
            for n, s in scores.items():
                top = s.max(axis=1)
                found[f"lse_{n}"].append(top + np.log(np.exp(s - top[:, None]).sum(axis=1)))
                here = at[part]
                found[f"hit_{n}"].append(np.where(here >= 0, s[np.arange(len(s)), here], 0.0))
        out = {c: np.concatenate(v) for c, v in found.items()}
        return pa.table({batch: lt.column(batch), id_col: lt.column(id_col), **out})

    left, right = q.select(batch, id_col, *needed), p.select(batch, id_col, "group", target, *needed)
    cells = batch_cells(left, right, batch, id_col, kernel, schema, rows)
    # A query cut from its batch's passages has a row for each block; its positive is in one of them.
    long = cells.select(batch, id_col, F.inline(F.array(*[
        F.struct(F.lit(n).alias("score"), F.col(f"lse_{n}").alias("lse"), F.col(f"hit_{n}").alias("hit")) for n in names
    ])))
    sums = log_sum_exp(long, [batch, id_col, "score"], "lse", "_lse", also=[F.col("hit")])
    per_score = [F.avg(F.when(F.col("score") == n, F.col("_lse") - F.col("_x0"))).alias(n) for n in names]
    return sums.agg(*per_score)


def distill_loss(
    scores: DataFrame, group: str, student: str = "student", teacher: str = "target"
) -> DataFrame:
    """-mean over groups of sum(teacher * log_softmax(student)); teacher holds probabilities."""
    product = F.col(teacher) * F.col(student)
    sums = log_sum_exp(scores, [group], student, "_lse", also=[product, F.col(teacher)])
    loss = F.col("_x1") * F.col("_lse") - F.col("_x0")
    return sums.select(loss.alias("loss")).agg(F.avg("loss").alias("loss"))


def blend_losses(
    losses: DataFrame, variant: str = "attention", self_distill: bool = False, out: str = "loss"
) -> DataFrame:
    """One loss from columns named after the parts; distilled parts are in columns distill_<part>."""
    blend = BLENDS[variant]

    def weighted(names: Sequence[str], prefix: str = "") -> Column:
        return sum((F.col(prefix + n) * blend["parts"][n] for n in names), F.lit(0.0))

    total = weighted(list(blend["parts"])) / blend["over"]
    if self_distill:
        students = [n for n in blend["parts"] if n != "ensemble"]
        total = (total + weighted(students, "distill_") / blend["distill_over"]) / 2
    return losses.withColumn(out, total)


def mean_eval_loss(losses: DataFrame, loss: str = "loss") -> DataFrame:
    return losses.agg(F.round(F.avg(loss), 4).alias(loss))
