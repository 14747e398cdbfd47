"""Targets, schedule and takes of the source mix."""

from collections import Counter, defaultdict

import pytest

from gleaner.llm import mixing
from gleaner.llm.common import Scratch
from gleaner.llm.queries import op10_mixing

SF = "/root/testdata/sf0.001"


def size(text):
    return len((text or "").encode("utf-8", "surrogatepass").split())


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what is over the stop is shared again until none is above."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in sources if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] >= most * sizes[s]}
        if not over:
            return target | {s: float(most * sizes[s]) for s in capped}
        capped |= over
        if len(capped) == len(sources):
            return {s: float(most * sizes[s]) for s in capped}


def check(got, rows, slack):
    sizes, source = defaultdict(int), {}
    for doc_id, text, s in rows:
        sizes[s] += size(text)
    targets = plain_targets(sizes)
    taken = Counter()
    for r, (doc_id, text, s) in zip(got, rows):
        assert (r["doc_id"], r["size"], r["source_size"]) == (doc_id, size(text), sizes[s])
        assert r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= slack


def test_query(spark, rows):
    got = sorted(op10_mixing(spark, SF).collect(), key=lambda r: r["doc_id"])
    check(got, [(r["doc_id"], r["text"], r["source"]) for r in rows], slack=3 * mixing.BLOCK)


def test_reruns_agree(spark, docs):
    first = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    again = sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    assert first == again


def test_odd_and_empty(odd, odd_rows, empty):
    got = mixing.mix_sources(odd, seed=1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((key((r["doc_id"], r["size"])) for r in got)) == sorted(key((r[0], size(r[1]))) for r in odd_rows)
    sizes = defaultdict(int)
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    targets = Counter(round(t, 3) for t in plain_targets(sizes).values())
    assert {round(r["target"], 3) for r in got} == set(targets)
    assert mixing.mix_sources(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    assert mixing.mix_sources(odd.where("text IS NULL")).select("taken").distinct().collect()[0][0] == 0


def test_schedule_is_spread_evenly(spark):
    """Every stretch of slots holds each source nearly in proportion, and blocks come in turn."""
    table = spark.createDataFrame([("a", 1000), ("b", 5000), ("c", 4000)], "source string, size long")
    scratch = Scratch(spark, "t")
    sources = scratch.keep(mixing.source_targets(table, scratch))
    rows = sorted(mixing.source_schedule(sources, scratch, block=10).collect(), key=lambda r: r["slot"])
    total = Counter(r["place"] for r in rows)
    for at in range(0, len(rows) - 100, 100):
        part = Counter(r["place"] for r in rows[at : at + 100])
        assert all(abs(part[p] - 100 * n / len(rows)) <= 4 for p, n in total.items())
    for place in total:
        own = [(r["pass"], r["block"]) for r in rows if r["place"] == place]
        assert own == sorted(own)


def test_mixed_documents_come_as_often_as_taken(docs):
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix_sources(docs).collect() if r["size"]}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mixed_documents(docs).columns == docs.columns
