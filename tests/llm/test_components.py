"""Components of long paths, stars and random graphs."""

import numpy as np
import pytest

from gleaner.llm.common import Scratch, running_sum
from gleaner.llm.components import components
from pyspark.sql import functions as F
from test_simhash import groups


def found(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r["node"]: r["root"] for r in components(df, Scratch(spark, "t")).collect()}


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_against_union_find(spark, kind):
    rng = np.random.default_rng(0)
    if kind == "path":
        order = rng.permutation(60).tolist()
        edges = list(zip(order, order[1:]))
    elif kind == "star":
        edges = [(30, i) for i in range(60) if i != 30]
    else:
        edges = rng.integers(0, 200, (150, 2)).tolist()
    root = groups(200, edges)
    size = {r: root.count(r) for r in root}
    got = found(spark, edges)
    assert all(got.get(i, i) == r for i, r in enumerate(root) if i in got or size[r] == 1)
    assert {i for i, r in enumerate(root) if i != r} <= set(got) | {r for r in got.values()}


def test_no_edges_and_loops(spark):
    assert found(spark, []) == {}
    assert found(spark, [(4, 4)]) == {}


def test_running_sum(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7 % 13)
    got = running_sum(df, [F.col("id").desc()], F.col("x"), "before", Scratch(spark, "t")).collect()
    total = 0
    for r in sorted(got, key=lambda r: -r["id"]):
        assert r["before"] == total
        total += r["x"]
