"""Quality rules and classifier: brute force, and held-out accuracy."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import quality_classifier, quality_rules
from gleaner.llm.common import Scratch
from gleaner.llm.queries import op5_quality_classifier, op7_quality_rules

SF = "/root/testdata/sf0.001"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = [False] * len(words)
    for i in range(len(words) - 7):
        if times[tuple(words[i : i + 8])] > 1:
            repeated[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * sum(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(repeated), failed


def plain_model(texts, order=4, symbols=64):
    """Interpolated modified Kneser-Ney by its textbook recursion over tuples."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * (order - 1) + quality_rules.symbols(t or "").tolist()
        grams[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discounts, totals, rests = {}, {}, {}
    for n in range(1, order + 1):
        of = Counter(grams[n].values())
        if of[1] and of[2] and of[3]:
            y = of[1] / (of[1] + 2 * of[2])
            d = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        else:
            d = [0.5] * 3
        discounts[n] = lambda c, d=d: d[min(c, 3) - 1]
        totals[n], rests[n] = Counter(), defaultdict(float)
        for g, c in grams[n].items():
            totals[n][g[:-1]] += c
            rests[n][g[:-1]] += discounts[n](c)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / symbols
        if g[:-1] not in totals[n]:
            return p(g[1:])
        c = grams[n][g]
        return (max(c - discounts[n](c), 0) if c else 0) / totals[n][g[:-1]] + rests[n][g[:-1]] / totals[n][g[:-1]] * p(g[1:])

    return p


def test_query_base_columns(spark, rows):
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in op7_quality_rules(spark, SF).collect()}
    assert got == {r["doc_id"]: plain_base(r["text"]) for r in rows}


def test_entropy_and_verdict_against_the_recursion(docs, rows):
    p = plain_model([r["text"] for r in rows])
    entropy = {}
    for r in rows:
        s = [0, 0, 0] + quality_rules.symbols(r["text"]).tolist()
        logs = [math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)]
        entropy[r["doc_id"]] = -sum(logs) / max(1, len(logs))
    length = {r["doc_id"]: len(r["text"]) for r in rows}
    got = quality_rules.quality_rules(docs).collect()
    for r in got:
        assert r["entropy"] == pytest.approx(entropy[r["doc_id"]], rel=1e-9)
    for lang in {r["lang"] for r in got}:
        own = sorted(r["entropy"] for r in got if r["lang"] == lang and not r["base_failed"])
        q1, q3 = own[math.ceil(len(own) / 4) - 1], own[math.ceil(3 * len(own) / 4) - 1]
        for r in got:
            if r["lang"] == lang:
                margin = 3 * (q3 - q1) * math.sqrt(1 + 600 / max(1, length[r["doc_id"]]))
                inside = q1 - margin <= r["entropy"] <= q3 + margin
                assert r["kept"] == (inside and not r["base_failed"])


def test_unseen_grams_back_off(spark, docs, rows):
    model = quality_rules.fit(docs, Scratch(spark, "t"))
    p = plain_model([r["text"] for r in rows])
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 64, (300, 4))
    codes = grams[:, 0] << 18 | grams[:, 1] << 12 | grams[:, 2] << 6 | grams[:, 3]
    want = [math.log(p(tuple(g))) for g in grams.tolist()]
    assert model.score(codes) == pytest.approx(want, rel=1e-9)


def test_rules_odd_and_empty(odd, odd_rows, empty):
    got = quality_rules.quality_rules(odd).collect()
    key = lambda r: repr((r["doc_id"], tuple(r[c] for c in BASE)))
    assert sorted(map(key, got)) == sorted(repr((r[0], plain_base(r[1]))) for r in odd_rows)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.quality_rules(empty).collect() == []


def test_symbols_spell_every_code_point():
    """Letters beyond ASCII shared three symbols, capitals those of small letters, and all digits one."""
    points = [*range(0x3000), *range(0x4E00, 0x4F00), 0xD800, *range(0xFF00, 0x10100), 0x1F600, 0x3FFFF, 0x40000, 0x10FFFF]
    spelled = [tuple(quality_rules.symbols(chr(c))) for c in points]
    assert len(set(spelled)) == len(points)
    begun = {s[:i] for s in spelled for i in range(1, len(s))}
    assert not begun & set(spelled)  # none begins another, so texts are told apart too
    assert all(0 <= x < quality_rules.SYMBOLS for s in spelled for x in s)
    text = "Ab 1\n\u00e9\u4e2d\U0010ffff"
    assert quality_rules.symbols(text).tolist() == [x for c in text for x in quality_rules.symbols(c)]
    assert quality_rules.symbols("").tolist() == []


def test_other_letters_of_a_script_are_less_likely(spark):
    """The same words with each letter three further on: by three classes of letters, they were as likely."""
    words = "\u0432\u043e\u0434\u0430 \u0438 \u043b\u0435\u0441 \u0441\u0442\u043e\u044f\u0442 \u0443 \u0434\u043e\u043c\u0430 "
    moved = "".join(c if c == " " else chr(ord(c) + 3) for c in words)
    rows = [(i, words * 6 + "\u043c" * (i % 3), "ru") for i in range(40)] + [(99, moved * 6, "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["entropy"] for r in quality_rules.quality_rules(docs).collect()}
    assert got[99] > max(e for i, e in got.items() if i != 99) + 0.1


def test_long_texts_in_slabs(monkeypatch):
    text = "some text of a few words " * 20
    whole = [np.concatenate(c) for c in zip(*quality_rules.gram_slabs([text, "", text]))]
    monkeypatch.setattr(quality_rules, "SLAB", 7)
    parts = [np.concatenate(c) for c in zip(*quality_rules.gram_slabs([text, "", text]))]
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_classifier_on_labels_it_has_not_seen(spark):
    """Trained on half of the labels, it judges the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("xxhash64(doc_id) % 2 = 0")
    truth = {r["doc_id"]: r["quality"] for r in labels.where("xxhash64(doc_id) % 2 != 0").collect()}
    got = quality_classifier.quality_scores(docs, train).collect()
    judged = [(truth[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in truth]
    assert len(got) == 1000 and len(judged) > 150
    good = [k for q, k in judged if q == 1]
    bad = [k for q, k in judged if q == 0]
    assert np.mean(good) >= 0.98
    assert np.mean(bad) <= 0.15


def test_classifier_query_and_filter(spark, docs):
    got = op5_quality_classifier(spark, SF).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])


def test_classifier_odd_and_empty(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 0), (5, 1), (6, None), (None, 1), (4, 1), (8, 1)], "doc_id long, quality int")
    assert quality_classifier.quality_scores(odd, labels).count() == len(odd_rows)
    none = labels.where("false")
    assert quality_classifier.keep_good(odd, none).count() == len(odd_rows)
    assert quality_classifier.quality_scores(empty, labels).collect() == []


def test_as_many_good_as_bad_labels_train_too(spark):
    good, bad = "plain words of a common text stand here and there", "$$$ ### $$$ %%% *** $$$ ### !!! &&& ***"
    rows = [(i, f"{good if i % 2 else bad} {i}", "en", "s", 50) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id < 40").selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    kept = {r["doc_id"] for r in quality_classifier.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(60) if i % 2}


def test_calibrated_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    model = quality_classifier.fit_logistic(x[:3000], y[:3000], x[3000:], y[3000:])
    assert model.logit(np.eye(3)) - model.logit(np.zeros((3, 3))) == pytest.approx([2, -1, 0], abs=0.35)
