"""Spelling variants against comparing every word with every string one edit away."""

import random
import re
import zlib
from collections import Counter

import pytest

from gleaner.llm.common import Scratch
from gleaner.llm.spelling import Acceptor, near_pairs, near_words, planted_slip, spelling_variants


def counts(texts):
    """(doc_id, text) to occurrences of words, with the planted slips."""
    out = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    """All strings one edit away."""
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]


def plain(words):
    letters = {c for w in words for c in w}
    rows = {}
    for word, n in words.items():
        near = {e for e in edits(word, letters) if e in words and e != word}
        best = min(near, key=lambda w: (-words[w], w), default=None)
        form = best if best and words[best] >= 2 * n else None
        rows[word] = [n, len(near), form, words[form] if form else None]
    out = []
    for word, (n, n_near, form, form_n) in rows.items():
        root = word
        while rows[root][2]:
            root = rows[root][2]
        out.append((word, n, n_near, form, form_n, root))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_whole_table(docs, rows):
    want = plain(counts([(r["doc_id"], r["text"]) for r in rows]))
    assert sum(r[3] is not None for r in want) > 100
    assert rows_of(spelling_variants(docs, respell=planted_slip)) == want


@pytest.mark.parametrize("most", [3, 20])
def test_large_partitions_are_parted_further(spark, most):
    rng = random.Random(7)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))): rng.randint(3, 60) for _ in range(600)}
    words |= {"x" * 5: 100, "x" * 6: 50, "x" * 7: 20, "xxxxy": 9, "yxxxx": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = near_words(df, Scratch(spark, "test"), most)
    got = {r["word"]: (r["n_near"], r["form"], r["form_n"]) for r in found.collect()}
    for word, n, n_near, *_ in plain(words):
        near = [w for w in set(edits(word, "abxy")) if w in words and w != word]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        assert got.get(word, (0, None, None)) == (n_near, best, words.get(best)), word


def test_pairs_of_acceptors():
    rng = random.Random(2)
    for _ in range(200):
        short, long = (sorted({"".join(rng.choice("abc") for _ in range(k)) for _ in range(rng.randint(0, 12))}) for k in (3, 4))
        x, y = near_pairs(short, long, True)
        words = short + long
        got = sorted((words[i], words[j]) for i, j in zip(x, y))
        want = {tuple(sorted((a, b), key=words.index)) for a in short for b in words if a != b and b in set(edits(a, "abc"))}
        assert got == sorted(want)


def test_acceptor_is_minimal_and_numbers_words():
    acceptor = Acceptor()
    start = acceptor.add(sorted(["tap", "taps", "top", "tops", "stop", "stops"]))
    assert len(acceptor.final) == 7  # s-t-(ao)-p-s share their ends: one state for each set of rests
    assert acceptor.words[start] == 6
    long = Acceptor()
    assert long.words[long.add(["a" * 20_000, "a" * 20_000 + "b"])] == 2


def test_odd_rows(spark, odd, odd_rows, empty):
    texts = [(r[0], r[1]) for r in odd_rows]
    assert rows_of(spelling_variants(odd, respell=planted_slip)) == plain(counts(texts))
    assert rows_of(spelling_variants(empty)) == []
    words = ["planet"] * 40 + ["plannet"] * 9 + ["plannett"] * 4 + ["plane"] * 3 + ["Ñandú"] * 12 + ["ñandúu"] * 5 + ["Plañet"] * 3 + ["a" * 3000] * 3 + ["a" * 3001] * 7
    df = spark.createDataFrame([(1, " ".join(words), 5, "w", "f")], "doc_id long, text string, n long, word string, form string")
    got = {r[0]: r for r in rows_of(spelling_variants(df))}
    assert got["plannett"] == ("plannett", 4, 1, "plannet", 9, "planet")
    assert got["plañet"] == ("plañet", 3, 1, "planet", 40, "planet")
    assert got["Ñandú"] == ("Ñandú", 12, 0, None, None, "Ñandú")  # only A-Z are lowered
    assert got["a" * 3000][3] == "a" * 3001
