"""Vector aggregates in Arrow across batch borders, against numpy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import attention
from gleaner.operators.aggregates import _by_group, first_by, vector_mean, vector_sum

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(params=["100", "10000"])
def batches(spark, request):
    kept = spark.conf.get(BATCH)
    spark.conf.set(BATCH, request.param)
    yield int(request.param)
    spark.conf.set(BATCH, kept)


def token_rows(spark, n):
    """Tokens of documents, a third of them in one; every element follows from the row's number."""
    doc = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 997)
    vec = F.array(F.col("id") % 11, F.col("id") % 7 - 3, F.lit(1)).cast("array<float>")
    return spark.range(n).select(doc.alias("doc_id"), F.col("id").alias("pos"), vec.alias("vec"))


def expected(n):
    at = np.arange(n)
    doc = np.where(at % 3 == 0, -1, at % 997)
    matrix = np.stack([at % 11, at % 7 - 3, np.ones(n)], axis=1)
    ids, where = np.unique(doc, return_inverse=True)
    sums = np.zeros((len(ids), 3))
    np.add.at(sums, where, matrix)
    return ids, sums, np.bincount(where), at, doc, matrix


def test_a_million_rows_in_batches_of_any_size(spark, batches):
    n = 1_000_000
    tokens = token_rows(spark, n)
    ids, sums, counts, at, doc, matrix = expected(n)
    mean = {r["doc_id"]: r["vec"] for r in attention.pool_mean(tokens).collect()}
    np.testing.assert_allclose([mean[i] for i in ids], sums / counts[:, None], rtol=1e-12)
    total = {r["doc_id"]: r["vec"] for r in vector_sum(tokens, ["doc_id"], "vec").collect()}
    np.testing.assert_allclose([total[i] for i in ids], sums)
    last = {r["doc_id"]: (r["pos"], r["vec"]) for r in first_by(tokens, "doc_id", "pos", last=True).collect()}
    for i in (-1, 0, 1, 996):
        place = at[doc == i].max()
        assert last[i] == (place, matrix[place].tolist())


def test_batches_of_many_rows_are_attended(spark, batches):
    """Cells of cut batches hand back several rows for each id, far more than an Arrow batch holds."""
    n = 3000
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 4))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, label int, vec array<double>")
    category = {r["id"]: r["category"] for r in attention.category_vectors(df, "label", rows=200).collect()}
    s = np.exp(x @ x.T)
    np.testing.assert_allclose([category[i] for i in range(n)], (s / s.sum(0, keepdims=True)) @ x, atol=1e-9)
    qkv = df.select("id", "label", *[F.col("vec").alias(c) for c in "qkv"])
    attended = {r["id"]: r["attended"] for r in attention.self_attention_vectors(qkv, "label", rows=200).collect()}
    s = np.exp(x @ x.T / 2)
    np.testing.assert_allclose([attended[i] for i in range(n)], (s / s.sum(1, keepdims=True)) @ x, atol=1e-9)


def test_groups_come_in_order_of_their_first_rows():
    """The last group of sorted rows must be that of the last row: it may go on in the next batch."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        ids = np.sort(rng.integers(0, 3000, 8))
        groups, rows, starts = _by_group(pa.table({"l": np.zeros(8, dtype=np.int32), "id": ids}), ["l", "id"])
        assert groups.column("id").to_pylist() == sorted(set(ids.tolist()))
        assert ids[rows[starts]].tolist() == groups.column("id").to_pylist()


def test_null_keys_null_vectors_and_empty_tables(spark):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 4.0]), (1, None), (2, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "k int, vec array<float>")
    assert {r["k"]: r["vec"] for r in vector_mean(df, ["k"], "vec").collect()} == {None: [2.0, 3.0], 2: [5.0, 6.0]}
    assert vector_sum(df.limit(0), ["k"], "vec").collect() == []


def test_vectors_of_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0, 3.0])], "k int, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        vector_sum(df, ["k"], "vec").collect()
