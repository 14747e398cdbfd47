"""Sketches and likeness against set arithmetic."""

import base64
import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import common, fingerprints
from gleaner.llm.common import Scratch
from gleaner.llm.queries import op6_fingerprints

SF = "/root/testdata/sf0.001"


STOPS, CLOSING = ".!?\u2026\u037e\u0589\u061f\u06d4\u0964\u0965\u1362", "\"'\u201d\u2019\u00bb)]"
WIDE, WIDE_CLOSING = "\u3002\uff01\uff1f\uff61", "\u300d\u300f\uff09\u201d\u2019"


def ends_sentence(text):
    return text[-1:] in STOPS and text != "" or len(text) > 1 and text[-1] in CLOSING and text[-2] in STOPS


def hashed(*parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed=seed)
    return seed


def cut(text):
    """Pieces by one walk over the text: lines and sentences; the first and those over 256 signs by their content."""
    pieces, piece = [], ""
    for i, c in enumerate(text):
        if c == "\n" or c == " " and ends_sentence(text[:i][-2:]):
            pieces.append(piece)
            piece = ""
            continue
        piece += c
        if c in WIDE and text[i + 1 : i + 2] not in WIDE + WIDE_CLOSING or c in WIDE and i + 1 == len(text):
            pieces.append(piece)
            piece = ""
    pieces.append(piece)
    out = set()
    for k, p in enumerate(pieces):
        if k and len(p) <= 256:
            out.add(p)
            continue
        part = ""
        for n, word in enumerate(p.split(" ")):
            part += " " * (n > 0)
            if len(word) <= 32:
                part += word
                if hashed(word) % 8 == 0:
                    out.add(part)
                    part = ""
                continue
            for i, c in enumerate(word):
                part += c
                if hashed(c, *[word[i + 1 : i + 3]] * (i + 1 < len(word))) % 16 == 0:
                    out.add(part)
                    part = ""
        out.add(part)
    return out - {""}


def likeness(a, b):
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b)) if cut(a) | cut(b) else 1.0


def expected(rows):
    """doc_id -> (n_chars, sha, near_edited, near_next) for rows with distinct ids, null first."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), likeness(t, edited), likeness(t, following))
    return out


def check(df, rows):
    want = expected(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(edited), pytest.approx(following))
    return got


def test_query(spark, rows):
    got = check(op6_fingerprints(spark, SF), [(r["doc_id"], r["text"]) for r in rows])
    text = {r["doc_id"]: r["text"] for r in rows}
    by_print = {}
    for r in got:
        by_print.setdefault(r["fingerprint"], set()).add(frozenset(cut(text[r["doc_id"]])))
    assert all(len(v) == 1 for v in by_print.values())
    same = {}
    for r in got:
        assert same.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_odd_rows_with_distinct_ids(spark, odd_rows, odd, empty):
    seen, rows = set(), []
    for r in odd_rows:
        if r[0] not in seen:
            seen.add(r[0])
            rows.append(r[:2])
    check(fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    assert fingerprints.document_fingerprints(odd).count() == len(odd_rows)
    assert fingerprints.document_fingerprints(empty).collect() == []
    alone = fingerprints.document_fingerprints(spark.createDataFrame([(3, "a b.")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0


def test_retries_recover_every_difference(spark, monkeypatch):
    """Sketches that are far too small at first are made larger until all digests are found."""
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for pair in range(20):
        shared, extra, lacks = (rng.integers(-(1 << 62), 1 << 62, int(n)).tolist() for n in rng.integers(0, 400, 3))
        rows.append((pair, shared + extra, shared + lacks))
        want[pair] = (len(extra), len(lacks))
    monkeypatch.setattr(fingerprints, "ROUNDS", 3)
    pairs = spark.createDataFrame(rows, "pair long, mine array<long>, theirs array<long>")
    got = fingerprints.recovered_differences(pairs, Scratch(spark, "t")).collect()
    assert {r["pair"]: (r["extra"], r["lacks"]) for r in got} == {k: v for k, v in want.items() if any(v)}


def test_no_shuffle_while_peeling(spark):
    pairs = spark.createDataFrame([(1, 4, [1, 2], [2])], "pair long, bits int, mine array<long>, theirs array<long>")
    plan = fingerprints.sketch_differences(pairs.repartition(3, "pair"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sketch_counts_every_digest(spark):
    rows = spark.createDataFrame([(1, list(range(9)), []), (2, [5], None)], "k long, a array<long>, b array<long>")
    found = fingerprints.sketch_strings(rows, "k", {"a": "x", "b": "y"}).collect()
    for r in found:
        for text, n in ((r["x"], 9 if r["k"] == 1 else 1), (r["y"], 0)):
            cells = np.frombuffer(base64.b64decode(text), dtype=">u4").reshape(24, 4)
            assert cells[:, 0].reshape(3, 8).sum(axis=1).tolist() == [n, n, n]
    assert len(found) == 2


def test_words_put_in_leave_the_other_parts(spark):
    """A long sentence, or a run of signs without a space, loses few digests when something is put in near its start."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("opqrstuv"), 6)) for _ in range(400)]
    signs = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 3000, 3000))
    pairs = [(" ".join(words), " ".join(words[:9] + ["new"] + words[9:])), (signs, signs[:9] + "新" + signs[9:])]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    for r in df.select("k", *[fingerprints.paragraph_digests(c).alias(c) for c in "ab"]).collect():
        a, b = set(r["a"]), set(r["b"])
        assert len(a) > 25 and len(a - b) <= 2 and len(b - a) <= 3


def test_kept_half_is_likeness_in_any_script(spark):
    """Texts of one line whose sentences end in other letters, digits or scripts, or that have no sentence ends."""
    rng = np.random.default_rng(6)

    def said(letters, n, end, between):
        word = lambda: "".join(rng.choice(list(letters), 6))
        return between.join(" ".join(word() for _ in range(9)) + end for _ in range(n))

    texts = [said("opqrstuvw", 10, ".", " "), said("ABCXYZ", 10, "!", " "), said("0123456789", 10, ".", " ")]
    texts += [said("абвгдежз", 10, ".", " "), said("αβγδεζη", 10, ";", " "), said("मनकहसर", 10, "।", " ")]
    texts += [said("中文字漢語", 10, "。", "").replace(" ", ""), "".join(rng.choice(list("中文字漢語"), 600))]
    texts += [said("opqrst", 10, "", " "), said("абвгд", 2, "", " ")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.document_fingerprints(df).collect()}
    assert all(0 < got[i]["near_edited"] < 1 and got[i]["near_next"] == 0 for i in range(len(texts)))


def test_a_peeling_round_is_one_aggregate_and_carries_no_digest(spark):
    pairs = spark.createDataFrame([(1, 6, list(range(40)), list(range(20, 55)))], "pair long, bits int, mine array<long>, theirs array<long>")
    differences = fingerprints.sketch_differences(pairs.repartition(3, "pair"))
    assert differences.collect()[0][1:] == (20, 15, 0)
    plan = differences._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") <= fingerprints.ROUNDS + 2  # the sketch, the rounds and the counts
    cells = spark.createDataFrame([(1, 3, 2, 1, 5)], "pair long, bits int, cell long, cnt long, key long")
    cells = cells.withColumn("chk", fingerprints._check(F.col("key")))
    cells = cells.unionByName(cells.selectExpr("pair", "bits", "-1L AS cell", "4L AS cnt", "0L AS key", "0L AS chk"))
    got = {r["cell"]: r["cnt"] for r in fingerprints._peeled(cells, ["pair", "bits"], 0).collect()}
    assert got[-1] == 5 and len(got) == 3  # taken out of two other tables, where it was not


def test_ends_without_wide_stops_are_those_of_the_whole_pattern(spark):
    texts = ["One. Two! (Three.) Four", 'A said "B." Then C.\nD', "", " . x", "1.5 is. ok", "e… f؟ g", "h。i. j！！k", "l. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = r"\n|(?<=[.!?…;։؟۔।॥።][\"'”’»)\]]?) |(?<=[。！？｡])(?![。！？｡」』）”’])"
    wide = df.select("t", F.split("t", old).alias("old"), F.split("t", fingerprints.PARAGRAPH_END).alias("new"), F.split("t", fingerprints.LINE_OR_SPACE_END).alias("plain"))
    for r in wide.collect():
        assert r["new"] == r["old"]
        assert r["plain"] == r["old"] or set(r["t"]) & set(fingerprints.WIDE_STOPS)


@pytest.mark.parametrize("most", [100_000, 0])
def test_a_retry_does_not_shuffle_all_pairs_again(spark, monkeypatch, most):
    """Rows of failed sketches are chosen as they are stored: by a broadcast, or by one shuffle before they are pairs."""
    rng = np.random.default_rng(3)
    texts = ["\n".join(f"line {i}" for i in rng.integers(0, 60, int(n))) for n in rng.integers(1, 120, 60)]
    rows = list(enumerate(texts))
    plans, keep = [], Scratch.keep

    def kept(self, df, **options):
        if {"mine", "theirs"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, **options)

    monkeypatch.setattr(Scratch, "keep", kept)
    monkeypatch.setattr(fingerprints, "ROUNDS", 3)
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans
    first = plans[0].split("== Initial Plan ==")[0]
    assert "REPARTITION" not in first  # not dealt before the failed ones are chosen
    assert ("Exchange hashpartitioning" in first) == (most == 0)
    if most == 0:  # the arrays are shuffled before the explode, by the row alone
        below = first[first.index("Generate") :]
        assert "Exchange hashpartitioning(row#" in below and "following" in below
