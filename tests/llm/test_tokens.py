"""Packing, token counts and training order against the tokenizers library."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from gleaner.llm import packing, token_counts as counting, tokens, training_order
from gleaner.llm.queries import op1_training_order, op3_packing, op8_token_counts
from gleaner.llm.token_counts import token_counts
from gleaner.session import new_path

SF = "/root/testdata/sf0.001"


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check_pieces(pieces, texts):
    """Every id lies in one piece, pieces have their ids' checksum, and sequences are gapless and not too long."""
    tokenizer = library("word_bpe_49k.json")
    wanted = defaultdict(int)
    for doc_id, text in texts:
        ids = ids_of(tokenizer, text) + [2]
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            crc = zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            wanted[doc_id, start, len(part), crc, len(ids)] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in pieces:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == wanted
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


def test_packing_query(spark, rows):
    pieces = op3_packing(spark, SF).collect()
    sequences = check_pieces(pieces, [(r["doc_id"], r["text"]) for r in rows])
    least = -(-sum(p["length"] for p in pieces) // 4096)
    assert len(sequences) <= 1.05 * least + 1


def test_packing_odd_and_empty(odd, odd_rows, empty):
    check_pieces(packing.pack_documents(odd).collect(), [r[:2] for r in odd_rows])
    assert packing.pack_documents(empty).collect() == []
    with_ids = packing.pack_documents(odd, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_packing_in_many_groups(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    check_pieces(packing.pack_documents(odd).collect(), [r[:2] for r in odd_rows])


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 500)
    window, offset = packing.best_fit_decreasing(lengths, 64)
    room, placed = {}, {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in room.values() if r >= lengths[i]]
        had = room.get(window[i], 64)
        assert (had == min(fits)) if fits else window[i] not in room
        assert offset[i] == 64 - had
        room[window[i]] = had - lengths[i]
        placed[i] = window[i]
    assert len(placed) == 500


WORDS = ["don't", "x'S", "ß'LL", "ÀÉ12³", "a\xa0b", "naïvé", "é", "¼½", "中文字", "a<|endoftext|>b", "''s", "İstanbul", "\x1fx", "µm", "№5", "…", "🙂🙂"]


def test_word_cache_equals_the_library(rows, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    texts = [r["text"] for r in rows] + [" ".join(WORDS), *WORDS, "a\x85b \x1c c"]
    tokenizer = library("word_bpe_49k.json")
    for found, text in zip(tokens.WordIds()(texts), texts):
        assert np.frombuffer(found, "<u4").tolist() == ids_of(tokenizer, text)


def test_token_counts_query(spark, rows):
    tokenizer = library("byte_bpe_50k.json")
    want = sorted((r["doc_id"], len(r["text"].encode()), n := len(ids_of(tokenizer, r["text"])), n > 1024) for r in rows)
    assert sorted(tuple(r) for r in op8_token_counts(spark, SF).collect()) == want


def test_token_counts_odd_and_empty(odd, odd_rows, empty):
    tokenizer = library("byte_bpe_50k.json")
    want = [(r[0], len((r[1] or "").encode()), len(ids_of(tokenizer, r[1]))) for r in odd_rows]
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_counts(empty).collect() == []


LATER = [
    "\u201cQuoted\u201d \u2014 it\u2019s here\u2026 and  there ", "\u4e2d\u6587\u5b57\u6f22\u8a9e\u3002\u3000\u4e2d\u6587 \u4e2d1\u6587", "\U0001f642\U0001f642 ok \U0001f642",
    "\u0967\u0968 \u0928\u092e\u0938\u094d\u0924\u0947\u0964", "\u2160\u2161 x\u2007\u2003y\u2028z", "\u05d0\u05d1 \u0661\u0662", "\ufeffstart\u200bend \u180e x",
]


def test_later_code_points_are_looked_up_too(monkeypatch):
    """Signs that the library classes as the pattern does: no text goes to it whole. Counts equal its own."""
    real, whole = counting.tokenizer, []

    class Watched:
        def __init__(self, name):
            self.real = real(name)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode(self, text, **options):
            whole.append(text)
            return self.real.encode(text, **options)

    library_ids = [len(ids_of(library("byte_bpe_50k.json"), t)) for t in LATER]
    monkeypatch.setattr(counting, "tokenizer", Watched)
    lengths = counting.PreTokenLengths("byte_bpe_50k.json", {})
    assert [lengths.count(t) for t in LATER] == library_ids
    assert whole == []


def test_every_sign_counts_as_in_the_library():
    """All signs of the first two planes between other signs, those included that the tables class differently."""
    lengths, tokenizer = counting.PreTokenLengths("byte_bpe_50k.json", {}), library("byte_bpe_50k.json")
    for start in range(0x80, 0x20000, 0x80):
        signs = [chr(c) for c in range(start, start + 0x80) if not 0xD800 <= c < 0xE000]
        if signs:
            texts = [f"a{c}1 {c}{c}b!{c}!" for c in signs]
            assert [lengths.count(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_summaries_hold_what_is_frequent():
    rng = np.random.default_rng(3)
    stream = [f"w{int(v)}" for v in rng.zipf(1.3, 40_000)]
    exact, found = counting.Counter(stream), counting.FrequentItems(50)
    for at in range(0, len(stream), 100):
        found.update(stream[at : at + 100])
    found.shrink()
    off = len(stream) / 51
    assert len(found.counts) <= 50
    assert all(exact[w] - off <= n <= exact[w] for w, n in found.counts.items())
    assert all(w in found.counts for w, n in exact.items() if n > off)


def test_frequent_table_comes_from_all_texts(spark, monkeypatch):
    """A pre-token that only the last of many documents hold, often, is in it."""
    monkeypatch.setattr(counting, "FREQUENT", 3)
    texts = [(f"word{i} and",) for i in range(3000)] + [("rareword " * 5000,), (None,)]
    table = counting.frequent_lengths(spark.createDataFrame(texts, "text string").repartition(3))
    assert set(table) > {" rareword", " and"}
    assert counting.frequent_lengths(spark.createDataFrame([], "text string")) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65_537])
def test_feistel_is_a_permutation(n):
    order = training_order.Feistel(n, key=7)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.sequence(slots).tolist() == list(range(n))
    if n > 100:
        assert (slots != training_order.Feistel(n, key=8).slot(np.arange(n))).any()
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def test_training_order_round_trip(spark, docs, rows):
    path = new_path(spark, "order")
    index = training_order.write_training_order(docs, path, length=64, shard=100).collect()
    read = {r["slot"]: r["ids"] for r in training_order.read_training_order(spark, path, 0, 64, 100).collect()}
    n = len(index)
    assert sorted(read) == list(range(n)) and n > 300
    tokenizer = library("word_bpe_49k.json")
    wanted = [i for r in docs.select("text").collect() for i in ids_of(tokenizer, r["text"]) + [2]]
    got = []
    for r in sorted(index, key=lambda r: r["sequence"]):
        ids = read[r["slot"]]
        assert zlib.crc32(np.array(ids, "<u2").tobytes()) == r["ids_crc32"]
        assert (r["shard"], r["record"]) == divmod(r["slot"], 100)
        got += ids[: r["n_tokens"]]
    assert sorted(got) == sorted(wanted)
    if docs.rdd.getNumPartitions() == 1:
        assert got == wanted
    later = training_order.read_training_order(spark, path, 150, 64, 100).collect()
    assert {r["slot"]: r["ids"] for r in later} == {s: i for s, i in read.items() if s >= 150}


def test_shards_have_a_fixed_stride(spark, docs, tmp_path):
    path = str(tmp_path / "shards")
    n = training_order.write_training_order(docs, path, length=64, shard=100).count()
    sizes = [f.stat().st_size for f in sorted((tmp_path / "shards").glob("part-*"))]
    assert sizes == [130 * 100] * (n // 100) + ([130 * (n % 100)] if n % 100 else [])


def test_training_order_odd_and_empty(spark, odd, empty):
    index = op1_training_order(spark, SF).collect()
    assert sorted(r["slot"] for r in index) == list(range(len(index)))
    assert training_order.write_training_order(odd, new_path(spark, "odd")).count() > 0
    assert training_order.write_training_order(empty, new_path(spark, "none")).collect() == []
