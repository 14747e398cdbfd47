"""Fingerprints, links and groups against brute force."""

import re

import numpy as np
import pytest
import xxhash

from gleaner.llm import simhash
from gleaner.llm.queries import op2_simhash


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def plain_fingerprint(text, width=3):
    w = words(text)
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = groups(len(fps), links)
    ids = {}
    for r, (doc_id, _) in zip(root, rows):
        if doc_id is not None:
            ids[r] = min(doc_id, ids.get(r, doc_id))
    return sorted(((d, f"{f:016x}", ids.get(r)) for (d, _), f, r in zip(rows, fps, root)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def expected_groups(rows):
    """(doc_id, text, root) of rows that have both."""
    fps = [plain_fingerprint(r["text"]) for r in rows]
    root = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    return [(r["doc_id"], r["text"], at) for r, at in zip(rows, root)]


def test_query_against_brute_force(spark, rows):
    got = found(op2_simhash(spark, "/root/testdata/sf0.001"))
    assert got == expected([(r["doc_id"], r["text"]) for r in rows])


def test_odd_rows(odd, odd_rows):
    assert found(simhash.simhash_groups(odd)) == expected([r[:2] for r in odd_rows])


def test_empty_table(empty):
    assert simhash.simhash_groups(empty).collect() == []
    assert simhash.drop_near_copies(empty).collect() == []


@pytest.mark.parametrize("tile", [3, 1024])
def test_close_edges_join_what_brute_force_joins(spark, monkeypatch, tile):
    """Clusters of fingerprints a bit or two apart, many in one cell, with small and large tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(1)
    centers = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centers}
    for c in centers:
        at = int(c)
        for _ in range(15):
            at ^= 1 << int(rng.integers(0, 64))
            fps.add(at)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from gleaner.llm.common import Scratch

    edges = simhash.close_edges(spark.createDataFrame([(s,) for s in signed], "fp long"), Scratch(spark, "t")).collect()
    place = {s: i for i, s in enumerate(signed)}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert all((fps[place[u]] ^ fps[place[v]]).bit_count() <= 64 for u, v in edges)
    assert groups(len(fps), [(place[u], place[v]) for u, v in edges]) == groups(len(fps), links)
    assert len(edges) <= 40 * len(fps)


def test_near_copies_against_brute_force(docs, rows):
    fps = [plain_fingerprint(r["text"]) for r in rows]
    root = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect())
    assert kept == sorted(rows[i]["doc_id"] for i in set(root)) and len(kept) < len(rows)


def test_drop_near_copies_on_odd_rows(odd):
    kept = simhash.drop_near_copies(odd).collect()
    assert simhash.drop_near_copies(odd).columns == odd.columns
    by_text = [r["text"] for r in kept]
    assert by_text.count(None) + by_text.count("") + by_text.count(" \n\t ") == 1
    fps = {plain_fingerprint(r["text"]) for r in kept}
    assert len(fps) == len(kept) == len({r[2] for r in expected_groups(odd.collect())})
