"""Exact top-k search over posting lists by MaxScore: score bounds part a query's terms, shards are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.operators.cells import parallelism

SHARD = 4096  # candidates whose postings a task holds at once
QUERIES = 1024  # queries a task holds
SEED = 128  # candidates that are scored outright for a first threshold
MOST_TASKS = 20_000
PROBED = 8  # non-essential terms that are looked up before candidates are dropped again


class Shard:
    """Candidates with their postings: for each dimension the places of positive and of negative components.

    A query's term is a dimension in which it isn't 0. Its gains are the postings of the same sign and have a
    bound, the largest component times the query's; those of the other sign can only lower a score.
    """

    def __init__(self, no_id: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.no_id, self.ids, self.vectors = no_id, ids, vectors
        self.postings = []  # [negative, positive] of each dimension: places, sizes of the components
        self.bounds = np.zeros((vectors.shape[1], 2), dtype=np.int64)
        for d, column in enumerate(vectors.T):
            lists = [(at, np.abs(column[at])) for at in (np.flatnonzero(column < 0), np.flatnonzero(column > 0))]
            self.postings.append(lists)
            self.bounds[d] = [values.max(initial=0) for _, values in lists]

    def search(self, query: np.ndarray, own: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all candidates that may score `least` or more; all candidates if it is None.

        Terms of the smallest bounds whose bounds add up to less than `least` are non-essential: no candidate
        can reach it by these alone. So only the postings of the others are walked, and each candidate met
        there is looked up in the rest, largest bounds first, as long as it can still reach `least`.
        """
        others = (self.ids != own) | self.no_id
        if least is None or least <= 0:  # candidates without any gain may be among the best
            places = np.flatnonzero(others)
            return places, self.vectors[places] @ query
        used = np.flatnonzero(query)
        sign, size = (query[used] > 0).astype(np.int64), np.abs(query[used])
        bounds = size * self.bounds[used, sign]
        order = np.argsort(-bounds, kind="stable")
        used, sign, size, bounds = used[order], sign[order], size[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the terms from here on can add at most
        essential = int(np.searchsorted(-rest, -least, side="right"))  # rest of this and all later ones < least
        gained = np.zeros(len(self.ids), dtype=np.int64)
        for d, s, w in zip(used[:essential], sign[:essential], size[:essential]):
            at, values = self.postings[d][s]
            gained[at] += w * values
        places = np.flatnonzero(others & (gained > 0) & (gained + rest[essential] >= least))
        scores = gained[places]
        # What candidates lose in the essential terms is looked up first, then the other terms.
        for at, end in [(0, essential), *((i, min(i + PROBED, len(used))) for i in range(essential, len(used), PROBED))]:
            if not len(places):
                break
            terms = used[at:end]
            found = self.vectors[places[:, None], terms] * query[terms]
            scores = scores + (np.minimum(found, 0) if at == 0 < essential else found).sum(axis=1)
            open_ = scores + rest[end] >= least
            places, scores = places[open_], scores[open_]
        return places, scores


class Answers:
    """The k best (score, id) of a query so far. Equal scores go by id, a null one last."""

    def __init__(self, k: int):
        self.k, self.found = k, np.empty((3, 0), dtype=np.int64)  # score, no id, id

    @property
    def least(self) -> int | None:
        """The score that a further candidate must reach to be among the k best."""
        return int(self.found[0, -1]) if self.found.shape[1] == self.k else None

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # the best k and what ties with the last of them
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, no_id, ids = scores[keep], no_id[keep], ids[keep]
        both = np.concatenate([self.found, np.stack([scores, no_id, ids])], axis=1)
        order = np.lexsort((both[2], both[1], -both[0]))
        self.found = both[:, order[: self.k]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; what a list lacks of the width is 0."""
    sizes = pc.list_value_length(column).to_numpy()
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = column.flatten().to_numpy()
    return out


def _checked(queries: np.ndarray, vectors: np.ndarray) -> None:
    most = [int(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    if most[0] * most[1] * max(1, vectors.shape[1]) >= 1 << 63:
        raise ValueError("components are too large for scores of 64 bits")


class _Cell:
    """One block of queries against a run of candidates, a shard at a time; answers and thresholds go along."""

    def __init__(self, k: int, width: int):
        self.k, self.width, self.queries, self.held, self.rows = k, width, [], [], 0

    def take(self, part: pa.RecordBatch) -> None:
        """Rows of one kind; all queries come before the first candidate."""
        no_id = part.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(part.column("id"), 0).to_numpy(zero_copy_only=False)
        vectors = _matrix(part.column("vec"), self.width)
        if part.column("is_row")[0].as_py():
            self.held.append((no_id, ids, vectors))
            self.rows += len(ids)
            if self.rows >= SHARD:
                self.work()
        else:
            numbers = part.column("query").to_pylist()
            self.queries += [(int(i), n, v, Answers(self.k)) for i, n, v in zip(ids, numbers, vectors)]

    def work(self) -> None:
        if self.rows and self.queries:
            no_id, ids, vectors = (np.concatenate(x) for x in zip(*self.held))
            _checked(np.stack([q[2] for q in self.queries]), vectors)
            first = 0
            if any(answers.least is None for *_, answers in self.queries):
                first = min(len(ids), max(SEED, 2 * self.k))
                self.search(Shard(no_id[:first], ids[:first], vectors[:first]))
            self.search(Shard(no_id[first:], ids[first:], vectors[first:]))
        self.held, self.rows = [], 0

    def search(self, shard: Shard) -> None:
        if len(shard.ids):
            for own, _, vector, answers in self.queries:
                at, scores = shard.search(vector, own, answers.least)
                answers.add(scores, shard.no_id[at], shard.ids[at])

    def answers(self) -> pa.RecordBatch:
        self.work()
        found = [answers.found for *_, answers in self.queries]
        sizes = [x.shape[1] for x in found]
        score, no_id, ids = np.concatenate([np.empty((3, 0), dtype=np.int64), *found], axis=1)
        number, own = (np.repeat(np.array([q[i] for q in self.queries], dtype=np.int64), sizes) for i in (1, 0))
        columns = [pa.array(number), pa.array(own), pa.array(ids, mask=no_id.astype(bool)), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])


def scaled(vec: Column, scale: int = 1024) -> Column:
    """floor(scale * component) of every component, as longs."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vec: Column) -> Column:
    """True for lists whose components are all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vec, finite), F.lit(False))


def max_score_search(queries: DataFrame, rows: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "vec") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of the largest inner product.

    Vectors are lists of longs; a component that is 0 or beyond the end of a list is a term the vector lacks.
    Rows with the query's own id are no candidates of it. Ties go to the smaller id, null ids last. Equal
    queries (id and vector) are answered once; queries without id or vector and rows without vector take no
    part, and neither do lists that hold a null. Repeated rows take a rank each. Scores that need more than 64
    bits are an error. Without queries or rows the result is empty. Further columns are not read.

    A task holds up to QUERIES queries and goes through its share of the rows, SHARD at a time, of which it builds
    the postings. The k-th score a query has so far is its threshold for the next shard. A task hands
    back k rows for each of its queries, and a ranked window merges them. Rows travel once for each block of
    queries.
    """
    whole = F.forall("vec", lambda x: x.isNotNull())
    asked, rows = (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<long>").alias("vec")).where(F.col("vec").isNotNull() & whole)
        for df in (queries, rows)
    )
    asked = asked.where("id IS NOT NULL").distinct()
    n_rows, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n_asked, asked_width = asked.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = max(1, width or 0, asked_width or 0)
    blocks = max(1, -(-n_asked // QUERIES))
    # Few long shares keep thresholds; a task for each core, and for more rows no more than 64 shards in one.
    shares = max(min(2 * parallelism(rows), -(-n_rows // SHARD)), -(-n_rows // (64 * SHARD)), 1)
    tasks = min(blocks * shares, MOST_TASKS)

    def dealt(df: DataFrame, is_row: bool, block: Column, share: Column) -> DataFrame:
        number = F.lit(None).cast("long") if is_row else F.xxhash64("id", "vec")
        cell = (block.cast("long") * shares + share.cast("long")).alias("cell")
        return df.select(cell, F.lit(is_row).alias("is_row"), number.alias("query"), "id", "vec")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    key = F.xxhash64("id", "vec")
    q = dealt(asked.withColumn("_s", every(shares)), False, F.pmod(key, F.lit(blocks)), F.col("_s"))
    r = dealt(rows.withColumn("_b", every(blocks)), True, F.col("_b"), F.pmod(key, F.lit(shares)))
    cells = q.unionByName(r).repartitionById(tasks, F.pmod("cell", F.lit(tasks).cast("long")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell = None, None
        for batch in batches:
            keys = np.stack([batch.column("cell").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)])
            ends = [*(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip([0, *ends], ends):
                if end > at:
                    if number != keys[0, at]:
                        if cell:
                            yield cell.answers()
                        number, cell = keys[0, at], _Cell(k, width)
                    for start in range(at, end, SHARD):
                        cell.take(batch.slice(start, min(SHARD, end - start)))
        if cell:
            yield cell.answers()

    found = cells.sortWithinPartitions("cell", "is_row").mapInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def search_embeddings(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The rows whose id is divisible by `every`, searched for among all rows by floor(1024 x) of their components.

    Vectors that are null or hold a null or a component that isn't finite take no part.
    """
    whole = rows.where(usable(F.col(vec))).select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vec)).alias("vec"))
    return max_score_search(whole.where(F.col("vec_id") % every == 0), whole, k)
