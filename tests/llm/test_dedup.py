"""Exact substrings and repeated paragraphs against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import paragraph_dedup, suffix_dedup
from gleaner.llm.queries import op4_paragraphs, op9_suffix_dedup
from test_simhash import groups

SF = "/root/testdata/sf0.001"


def removals(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256) of each text, counting every string there is."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def expected(rows, length=400):
    return sorted(((i, *r) for (i, _), r in zip(rows, removals([t for _, t in rows], length))), key=repr)


def test_suffix_query(spark, rows):
    assert found(op9_suffix_dedup(spark, SF)) == expected([(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("hot", [20_000, 3])
def test_shared_passages_and_hot_anchors(spark, monkeypatch, hot):
    """Passages in the midst of unlike texts, periodic texts, zero bytes, and anchors counted string by string."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh \n\0é"), n))
    passages = [word(n) for n in (150, 100, 99, 300)]
    texts = [word(rng.integers(0, 400)) + p + word(rng.integers(0, 400)) for p in passages for _ in range(6)]
    texts += ["ab" * 400, "x" * 350, "ab" * 150 + word(50), None, "", passages[0], passages[0]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(df, length=100)) == expected(rows, 100)


def test_suffix_odd_and_empty(spark, odd_rows, odd, empty):
    short = [(r[0], r[1][:3000] if r[1] else r[1]) for r in odd_rows]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(df)) == expected(short)
    assert suffix_dedup.remove_repeats(odd).count() == len(odd_rows)
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_long_texts_are_cut_into_slabs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 700)
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcd"), 6000))
    rows = [(1, text), (2, "zz" + text[1000:3000] + "yy"), (3, text[4000:4450])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(suffix_dedup.remove_repeats(df)) == expected(rows)


def plain_words(text):
    return text.encode("utf-8", "surrogatepass").lower().split()


def plain_removed(rows):
    """Sentences that go, by comparing all lines and all sentences in them with one another."""
    units = []  # (order, row, words)
    parts = {}
    for k, (doc_id, text) in enumerate(rows):
        cut = paragraph_dedup.sentences(text or "")
        assert "".join(cut) == (text or "")
        parts[k] = cut
        at = 0
        while at < len(cut):
            end = at + 1
            while end < len(cut) and not cut[end - 1].endswith("\n"):
                end += 1
            for i in range(at, end) if end - at > 1 else ():
                units.append(((doc_id, i, 1), k, plain_words(cut[i])))
            units.append(((doc_id, at, end - at), k, plain_words("".join(cut[at:end]))))
            at = end
    units = [u for u in units if len(u[2]) >= 5]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, _, w in units]
    links = []
    for i in range(len(units)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            alike = len(a & b) >= 0.8 * len(a | b)
            if units[i][2] == units[j][2] or alike:
                links.append((i, j))
    root = groups(len(units), links)
    first = {}
    for r, (order, *_) in zip(root, units):
        first[r] = min(order, first.get(r, order))
    places = defaultdict(list)
    for r, (order, k, *_) in zip(root, units):
        if order != first[r]:
            places[k].append({"place": order[1], "span": order[2]})
    return [len(paragraph_dedup._removed(parts[k], places[k])) for k in range(len(rows))]


def test_paragraph_query(spark, rows):
    got = {r["doc_id"]: r["n_removed"] for r in op4_paragraphs(spark, SF).collect()}
    want = plain_removed([(r["doc_id"], r["text"]) for r in rows])
    assert [got[r["doc_id"]] for r in rows] == want
    assert sum(want) > 50


def test_passages_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(3)
    sentence = lambda: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(9)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(7))
    texts = [f"{sentence()} {sentence()[:-1]} {passage} {sentence()}\n{sentence()}" for _ in range(40)]
    clean = [" ".join(sentence() for _ in range(6)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in paragraph_dedup.paragraph_removals(df).collect()}
    assert [got[i]["n_removed"] > 0 for i in range(80)] == [False] + [True] * 39 + [False] * 40
    assert all(got[i]["kept_text"] == clean[i - 40] for i in range(40, 80))


@pytest.mark.parametrize("block", [2, 256])
def test_many_near_copies_of_a_line(spark, monkeypatch, block):
    """Each line has its own last word; all share most shingles and are one cluster, however they are dealt."""
    monkeypatch.setattr("gleaner.llm.collisions.BLOCK", block)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{base} end{i}") for i in range(30)] + [(99, base.replace("w3", "v3").replace("w30", "v30").replace("w50", "v50"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.paragraph_removals(df).collect()}
    assert [got[i] for i in range(30)] == [0] + [1] * 29
    assert [got[i] for i, _ in rows] == plain_removed(rows)


def test_paragraphs_odd_and_empty(odd, odd_rows, empty):
    assert paragraph_dedup.paragraph_removals(odd).count() == len(odd_rows)
    kept = paragraph_dedup.remove_repeated_paragraphs(odd)
    assert kept.columns == odd.columns
    by_id = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert by_id[1] is None and by_id[2] == "" and by_id[13] == "a" * 5000
    assert 7 not in by_id or by_id[7] != by_id[6]
    assert paragraph_dedup.paragraph_removals(empty).collect() == []
    assert paragraph_dedup.remove_repeated_paragraphs(empty).collect() == []


def near_passage(rng):
    """Two texts that are unlike but for a passage with a word changed in each of its sentences."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    own = lambda: " ".join(word() for _ in range(30)).capitalize() + "."
    passage = [[word() for _ in range(60)] for _ in range(3)]
    changed = [[*s[:30], word(), *s[31:]] for s in passage]
    said = lambda p: " ".join(" ".join(s) + "." for s in p)
    return [f"{own()} {own()} {said(p)} {own()} {own()}" for p in (passage, changed)]


def test_similar_sentences_within_unlike_lines(spark):
    rng = np.random.default_rng(8)
    texts = [t for _ in range(20) for t in near_passage(rng)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in paragraph_dedup.paragraph_removals(df).collect()}
    assert [got[i]["n_removed"] for i in range(40)] == [0, 3] * 20
    assert all(got[i]["removed_words"] == 180 * (i % 2) for i in range(40))


def test_sentences_in_lines_against_brute_force(spark):
    """Edges between all paragraphs, lines or not, are those of the exact similarity."""
    rng = np.random.default_rng(9)
    rows = list(enumerate(t for _ in range(10) for t in near_passage(rng)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from gleaner.llm.common import Scratch

    scratch = Scratch(spark, "t")
    table = scratch.keep(paragraph_dedup.paragraph_table(df, "doc_id", "text"))
    at = {r["par"]: (r["doc_id"], r["place"], r["span"]) for r in table.collect()}
    different = paragraph_dedup.different_paragraphs(table, scratch)
    edges = paragraph_dedup.similar_paragraphs(df, different, scratch, "doc_id", "text").collect()
    got = {frozenset((at[r["u"]], at[r["v"]])) for r in edges}
    units = []
    for i, text in rows:
        cut = paragraph_dedup.sentences(text)
        units += [((i, k, 1), plain_words(c)) for k, c in enumerate(cut)] + [((i, 0, len(cut)), plain_words(text))]
    sets = [(at_, {tuple(w[i : i + 5]) for i in range(len(w) - 4)}) for at_, w in units]
    want = {frozenset((a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= 0.8 * len(x | y)}
    assert got == want and len(want) == 30


def test_shingles_of_paragraphs_are_in_no_table(spark, monkeypatch):
    """They go from the texts straight to the tasks that compare them; rows that come twice are read once."""
    from gleaner.llm import common, paragraph_dedup

    line = " ".join(f"word{i}" for i in range(30))
    rows = [(1, line + " end"), (2, line + " last"), (2, line + " last"), (None, "x " + line + " end"), (4, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, keep = [], common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, **o: kept.append(df.columns) or keep(self, df, **o))
    got = {(r["doc_id"], r["n_removed"]) for r in paragraph_dedup.paragraph_removals(docs).collect()}
    assert got == {(1, 0), (2, 1), (None, 1), (4, 0)}
    assert kept and not [c for c in kept if "shingles" in c]


def test_sentences_meet_their_own_line_where_they_are_cut(spark, monkeypatch):
    """A line and a sentence of it that share a band with no other go into no task; what is found stays the same."""
    rng = np.random.default_rng(12)
    said = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n)) + "."
    rows = list(enumerate(f"{said(40)} {said(n)}\n{said(20)}" for n in (5, 6, 8, 12, 25) * 4))
    rows += [(20, rows[0][1].split("\n")[0] + "\n" + said(9)), (21, "three short words")]
    compared = []
    paired = paragraph_dedup.paired
    monkeypatch.setattr(paragraph_dedup, "paired", lambda members: compared.append(members.count()) or paired(members))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.paragraph_removals(df).collect()}
    assert [got[i] for i, _ in rows] == plain_removed(rows)
    assert sum(n > 0 for n in got.values()) > 10
    assert compared == [0]


def test_fewer_words_than_a_shingle_in_all(spark):
    df = spark.createDataFrame([(1, "three short words")], "doc_id long, text string").coalesce(1)
    assert [r["kept_text"] for r in paragraph_dedup.paragraph_removals(df).collect()] == ["three short words"]


@pytest.mark.parametrize("words, bytes_each, gone", [(60, 8, True), (60, 5, False), (100, 5, True)])
def test_long_passages_go_by_bytes_not_words(spark, words, bytes_each, gone):
    """A passage of over 50 words that two texts share goes from both if it has 400 bytes, else it stays."""
    rng = np.random.default_rng(words)
    said = lambda n, k: " ".join("".join(rng.choice(list("abcdefghij"), k - 1)) for _ in range(n))
    passage = said(words, bytes_each)
    assert (len(passage) >= 400) == gone
    rows = [(i, f"{i}{said(40, 7)}!{passage}?{i}{said(30, 7)}") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(suffix_dedup.remove_repeats(df))
    assert got == expected(rows)
    assert [r[2] for r in got] == [(len(passage) + 2) * gone] * 2
