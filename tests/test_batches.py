"""Batches for training ranks, batch maps, files and their columns, tokenizers that are asked in batches."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.catalog.inputs import training_rows
from gleaner.catalog.record_queries import _make_byte_pair_counts
from gleaner.operators import ordering, records
from gleaner.plans import loading
from gleaner.sources import tables


@pytest.mark.parametrize("n,batch,ranks", [(100, 7, 4), (96, 4, 6), (3, 5, 4), (1, 2, 2), (0, 4, 2)])
def test_ranks_have_equal_numbers_of_batches_and_lose_no_row(spark, n, batch, ranks):
    df = spark.range(n).withColumnRenamed("id", "k")
    rows = ordering.rank_batches(df, "k", batch, ranks).collect()
    own = [r["k"] for r in rows if not r["padded"]]
    assert sorted(own) == list(range(n))  # each row once
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(rows) % (batch * ranks) == 0
    assert len(rows) - n < batch * ranks
    by_rank = {}
    for r in rows:
        assert r["batch"] == r["slot"] // batch and r["rank"] == r["batch"] % ranks and r["step"] == r["batch"] // ranks
        by_rank.setdefault(r["rank"], set()).add(r["step"])
    assert len({frozenset(s) for s in by_rank.values()}) <= 1 and len(by_rank) == (ranks if n else 0)
    order = {r["slot"]: r["k"] for r in rows}
    assert all(order[s] == order[s % n] for s in order)  # filled up from the beginning


def test_ranks_drop_what_is_over_and_resume(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    kept = ordering.rank_batches(df, "k", 7, 4, uneven="drop").collect()
    assert len(kept) == 84 and len({r["k"] for r in kept}) == 84 and not any(r["padded"] for r in kept)
    whole = ordering.rank_batches(df.repartition(5), "k", 7, 4)
    later = ordering.rank_batches(df, "k", 7, 4, first_step=2)
    assert sorted(later.collect()) == sorted(whole.where("step >= 2").collect())
    other = ordering.rank_batches(df, "k", 7, 4, epoch=1)
    assert sorted(other.select("k", "slot").collect()) != sorted(whole.select("k", "slot").collect())
    with pytest.raises(ValueError, match="pad or drop"):
        ordering.rank_batches(df, "k", 7, 4, uneven="keep")


@pytest.mark.parametrize("batch_rows", [3, 1000])
def test_map_batches_keeps_rows_and_order(spark, batch_rows):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("t"), F.array("id").alias("l"), F.lit(None).cast("string").alias("z")).coalesce(1)

    def make():
        seen = []  # state of a task

        def fn(batch):
            seen.append(batch.num_rows)
            assert batch.num_rows <= batch_rows and batch.schema.names == ["id"]
            return {"t": np.array([2.0 * i for i in batch.column(0).to_pylist()]), "calls": [len(seen)] * batch.num_rows}

        return fn

    out = records.map_batches(df, make, "t double, calls long", ["z"], ["id"], batch_rows)
    assert out.columns == ["id", "l", "t", "calls"]
    rows = out.collect()
    assert [(r["id"], r["l"], r["t"]) for r in rows] == [(i, [i], 2.0 * i) for i in range(50)]
    assert [r["calls"] for r in rows] == [i // batch_rows + 1 for i in range(50)]


def test_map_batches_can_change_the_number_of_rows_only_without_other_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, "c")], "id long, t string")
    words = lambda: lambda b: {"w": [w for t in b.column("t").to_pylist() for w in t.split()]}
    assert sorted(r["w"] for r in records.map_batches(df, words, "w string", ["id", "t"]).collect()) == ["a", "b", "c"]
    with pytest.raises(Exception, match="rows of"):
        records.map_batches(df.where("id <> 2").coalesce(1), words, "w string", ["t"]).collect()
    with pytest.raises(Exception, match="no column w"):
        records.map_batches(df, lambda: lambda b: {}, "w string").collect()
    with pytest.raises(ValueError, match="no such columns: x"):
        records.map_batches(df, words, "w string", ["x"])
    with pytest.raises(Exception):
        records.map_batches(df, lambda: lambda b: {"w": ["no number"] * b.num_rows}, "w int").collect()
    assert records.map_batches(df.limit(0), words, "w string", ["id", "t"]).collect() == []


def test_files_have_the_columns_their_lines_name(spark, tmp_path):
    row = {"id": 1, "query": "q", "pos": ["p"], "neg": ["n"]}
    (tmp_path / "scored.jsonl").write_text("\n".join(json.dumps(row | {"pos_scores": [0.5], "neg_scores": [0.1]}) for _ in range(3)))
    (tmp_path / "nulls.jsonl").write_text("\n".join(json.dumps(row | {"pos_scores": None, "neg_scores": None}) for _ in range(3)))
    (tmp_path / "one.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"pos_scores": None}))
    (tmp_path / "bare.jsonl").write_text(json.dumps(row | {"query": '"pos_scores": neg_scores'}))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text('{"pos_scores": 1}')
    found = {r["file"].rsplit("/", 1)[1]: (r["pos_scores"], r["neg_scores"]) for r in tables.file_columns(spark, [str(tmp_path)]).collect()}
    assert found == {"scored.jsonl": (True, True), "nulls.jsonl": (True, True), "one.json": (True, False), "bare.jsonl": (False, False)}
    with pytest.raises(ValueError) as error:
        loading.load_training_rows(spark, [str(tmp_path)], distill=True)
    named = str(error.value)
    assert "one.json" in named and "bare.jsonl" in named and "nulls.jsonl" not in named and "scored.jsonl" not in named
    good = [str(tmp_path / f) for f in ("scored.jsonl", "nulls.jsonl")]
    assert loading.load_training_rows(spark, good, distill=True).count() == 6
    with pytest.raises(Exception, match="no number"):  # the nulls are found where scores are used
        loading.load_training_groups(spark, good, group_size=2, distill=True).collect()


def test_a_tokenizer_counts_many_texts_at_once(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows, count = training_rows(spark, sf_dir), _make_byte_pair_counts()
    local = rows.collect()
    want = (max(count([r["query"]])[0] for r in local), max(max(count(r["pos"] + r["neg"])) for r in local))
    assert tuple(records.max_token_len(rows, make_tokenizer=_make_byte_pair_counts).first()) == want
    odd = spark.createDataFrame([(None, None, ["x y"]), ("q", [None, "a b c"], []), ("", [], None)], "query string, pos array<string>, neg array<string>")

    def make():
        def words(texts):
            assert len(texts) <= 1000 and None not in texts
            return [len(t.split()) for t in texts]

        return words

    assert tuple(records.max_token_len(odd, make_tokenizer=make).first()) == (1, 3)
    assert tuple(records.max_token_len(odd.limit(0), make_tokenizer=make).first()) == (None, None)
    assert tuple(records.max_token_len(odd).first()) == (1, 3)


def test_counts_by_pieces_equal_the_library():
    """Every piece goes to the library once, however often it comes; odd white space and special strings are as in it."""
    from gleaner.catalog import record_queries
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        "", " ", "a", " a", "a ", "two words", "two  words", "tab\there and\n there", "a \n b", "it's they'll 12 3,4 x-y",
        "été 中文 中", "a b 　c", "x \x1c y", "a\x1fb c", "see <|endoftext|> end", "<|endoftext|>", "<|end oftext|>",
        "word " * 50, " 's 's' s", "a\x85 b", "long" * 40 + " " + "long" * 40,
    ]
    rng = np.random.default_rng(0)
    signs = list(" \t\n ab1'.,-é中\x1c")
    texts += ["".join(rng.choice(signs, 30)) for _ in range(500)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert record_queries._make_byte_pair_counts()(texts) == want
    asked = []

    def count(pieces):
        asked.extend(pieces)
        return [len(p) for p in pieces]

    counted = records.counts_by_pieces(count)
    assert counted(["to be or not to be", "to be"]) + counted(["not to be"]) == [18, 5, 9]
    assert sorted(asked) == sorted(["to", " be", " or", " not", " to", "not"])
