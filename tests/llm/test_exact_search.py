"""MaxScore search against scoring every row for every query."""

import math

import numpy as np
import pytest

from gleaner.llm import exact_search
from gleaner.llm.exact_search import Shard, max_score_search, search_embeddings


def plain(queries, rows, k=10):
    """Rows (query_id, rank, vec_id, score); queries and rows are (id, list of whole numbers)."""
    out = []
    for q, vector in {(i, tuple(v)) for i, v in queries if i is not None and v is not None}:
        hits = [(-sum(a * b for a, b in zip(vector, v)), i is None, i or 0) for i, v in rows if v is not None and i != q]
        out += [(q, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [math.floor(1024 * float(x)) for x in r["embedding"]]) for r in table.collect()]
    want = plain([r for r in rows if r[0] % 100 == 0], rows)
    assert len(want) == 50
    assert rows_of(search_embeddings(table)) == want


@pytest.mark.parametrize("shard,queries", [(50, 7), (4096, 1024)])
def test_blocks_change_nothing(spark, monkeypatch, shard, queries):
    """Many small shards carry thresholds from one to the next; ties are everywhere."""
    monkeypatch.setattr(exact_search, "SHARD", shard)
    monkeypatch.setattr(exact_search, "QUERIES", queries)
    monkeypatch.setattr(exact_search, "SEED", 20)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 12) * rng.integers(0, 2, 12)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<long>").repartition(5)
    asked = [r for r in rows if r[0] % 50 == 0]
    assert rows_of(max_score_search(df.where("vec_id % 50 = 0"), df)) == plain(asked, rows)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5]), (100, [0.5]), (200, []), (300, None), (400, [None, 1.0]), (500, [float("nan"), 1.0]), (600, [float("inf"), 1.0]),
        (None, [1.0, 0.5]), (None, None), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, -2.0]), (0, [1.0, 0.5]), (0, [2.0, 2.0]), (3, [0.0, 0.0]),
    ]
    more = [(i, v, 7, "x", 1) for i, v in rows]
    df = spark.createDataFrame(more, "vec_id long, embedding array<double>, query long, cell string, score int")
    good = [(i, None if v is None or not all(x is not None and math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]) for i, v in rows]
    got = rows_of(search_embeddings(df, k=4))
    assert got == plain([r for r in good if r[0] is not None and r[0] % 100 == 0], good, 4)
    assert {r[0] for r in got} == {0, 100, 200}
    assert rows_of(search_embeddings(df.limit(0))) == []


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<double>")
    assert rows_of(search_embeddings(df)) == [(0, 1, 1, 1024 * 512)]


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id long, vec array<long>")
    with pytest.raises(Exception, match="too large"):
        max_score_search(df, df).collect()


def test_a_shard_drops_candidates_and_loses_none():
    """With a threshold only part of the candidates is scored to the end, and all that reach it are."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-100, 101, (2000, 24))
    shard = Shard(np.zeros(2000, dtype=bool), np.arange(2000), vectors)
    for _ in range(20):
        query = rng.integers(-100, 101, 24)
        scores = vectors @ query
        least = int(np.sort(scores)[-10])
        at, found = shard.search(query, -1, least)
        assert (found == scores[at]).all()
        assert set(np.flatnonzero(scores >= least)) == set(at)
