"""Ranked lexical search against scoring every document for every item."""

import math
import re

import numpy as np
import pytest

from gleaner.llm import lexical_search
from gleaner.llm.lexical_search import exact_parts, product, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score) of documents and items (id, text)."""
    split_docs = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in split_docs), sum(len(w) for _, w in split_docs)
    df = {}
    for _, words in split_docs:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        hits = []
        for doc, words in split_docs:
            m = 25 + 75 * len(words) * n_docs // max(1, n_terms)
            score = 0
            for t in split(text):
                if tf := words.count(t):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                hits.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_whole_table(docs, rows, items):
    want = plain([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in items.collect()])
    assert len(want) > 100
    assert rows_of(ranked_search(docs, items)) == want


def test_passes_and_tiles_change_nothing(docs, items, monkeypatch):
    want = rows_of(ranked_search(docs, items))
    monkeypatch.setattr(lexical_search, "TILE_BYTES", 3000)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 5)
    assert rows_of(ranked_search(docs.repartition(5), items.repartition(3))) == want


def test_odd_rows(spark, odd, odd_rows, empty):
    asked = [(1, "One TWO three"), (2, None), (3, ""), (None, "same words"), (4, "same"), (4, "same"), (5, "Ünïcode ß 中文字 🙂"), (6, "w4x2 " * 500)]
    items = spark.createDataFrame([(i, t, 7, "x") for i, t in asked], "item_id long, text string, doc_id long, score string")
    texts = [(r[0], r[1]) for r in odd_rows]
    assert rows_of(ranked_search(odd, items)) == plain(texts, asked)
    assert rows_of(ranked_search(empty, items)) == []
    assert rows_of(ranked_search(odd, items.limit(0))) == []


def test_ties_go_by_document(spark):
    docs = spark.createDataFrame([(i, "apple pear") for i in range(50, 0, -1)] + [(99, "plum")] * 60, "doc_id long, text string")
    items = spark.createDataFrame([(1, "apple")], "item_id long, text string")
    assert [r[2] for r in sorted(rows_of(ranked_search(docs.repartition(7), items)), key=lambda r: r[1])] == list(range(1, 11))


def test_products_stay_exact():
    """Weights too large for one product are taken in parts; results equal Python's whole numbers."""
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 1 << 33, (3, 40))
    found = rng.integers(0, 10**6, (40, 5))
    want = [[sum(int(a) * int(b) for a, b in zip(w, f)) for f in found.T] for w in weights]
    assert len(exact_parts(weights)) > 1
    assert all(part.sum(axis=1).max() * 10**6 < 2**53 for part in exact_parts(weights))
    assert (sum(part.astype(int) for part in exact_parts(weights)) == weights).all()
    assert product(weights, found.astype(float)).tolist() == want
