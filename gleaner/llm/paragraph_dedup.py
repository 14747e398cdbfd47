"""Substring dedup by paragraphs: MinHash bands, exact Jaccard on colliding ones, clusters, one occurrence stays."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gleaner.llm.common import ROW, Scratch, arrow_pass, short_batches, signed, slices, spans, within
from gleaner.llm.collisions import colliding, paired, sharing, tied
from gleaner.llm.components import components
from gleaner.llm.shingles import (
    SIMILARITY, WIDTH, bands_at, chain, identities, shingles, similar, similar_part, tune_bands, word_hashes,
)

TASK = {"band": pa.int64(), "p": pa.int32(), "q": pa.int32(), "first": pa.bool_(), "par": pa.int64()}
FETCHED = 1000  # sets of shingles that are handed on at once
MIN_RUN = 20  # words that the repeated paragraphs of a run must have in all

#: A sentence ends with its line or after its full stop, white space included.
_SENTENCE = re.compile(r"[^.!?\n]*+(?:[.!?]++(?![ \t\r\f\v])[^.!?\n]*+)*+(?:[.!?]++[ \t\r\f\v]++\n*+|\n++|\Z)")


def sentences(text: str) -> list[str]:
    """The text cut into sentences; joined they are the text again."""
    return [p for p in _SENTENCE.findall(text) if p]


def paragraph_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, place, span, par, line, near, bands): the paragraphs of every text, of at least WIDTH words.

    A paragraph is a line, and each sentence of a line too, so that a passage put into the midst of another
    line still has paragraphs of its own. place is its first sentence, span the number of them, par a 64-bit
    hash of its words. Both have bands, a hash for each MinHash band; those whose shingles are too few to
    reach the similarity with another number have none and match as equals.

    line is the par of the line that a sentence lies in, null for lines. near is true of a sentence that shares
    a band with its line and is similar to it, which is told here, where both are at hand.
    """
    n_bands = tune_bands()
    least = math.ceil(SIMILARITY / (1 - SIMILARITY))  # of n and n + 1 shingles, n / (n + 1) must reach it

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [sentences(t or "") for t in batch.column(2).to_pylist()]
        per_text = np.array([len(p) for p in parts], dtype=np.int64)
        flat = [p for ps in parts for p in ps]
        number, place = np.repeat(np.arange(len(parts)), per_text), within(per_text)
        hashes, sizes = word_hashes(flat)
        # A line ends after a sentence with a line feed, and with the text.
        last = np.array([p.endswith("\n") for p in flat], dtype=bool)
        last[np.cumsum(per_text)[per_text > 0] - 1] = True
        ends = np.flatnonzero(last) + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        words = spans(sizes)
        line_sizes = words[ends] - words[starts]
        # Sentences that are not lines by themselves, then lines; a line counts as one paragraph of its words.
        alone = np.zeros(len(flat), dtype=bool)
        alone[starts[ends - starts == 1]] = True
        inner = np.flatnonzero(~alone & (sizes >= WIDTH))
        whole = np.flatnonzero(line_sizes >= WIDTH)
        owner = number[np.concatenate([inner, starts[whole]])]
        lines = identities(hashes, line_sizes)
        par = np.concatenate([identities(hashes, sizes)[inner], lines[whole]])
        line_of = np.repeat(np.arange(len(ends)), ends - starts[: len(ends)])[inner]
        line = pa.array(np.concatenate([signed(lines[line_of]), np.zeros(len(whole), np.int64)]), mask=np.arange(len(par)) >= len(inner))
        first = place[np.concatenate([inner, starts[whole]])]
        span = np.concatenate([np.ones(len(inner), dtype=np.int64), (ends - starts)[whole]])
        # Lines and the sentences in them have their shingles in the same array, which is hashed once.
        counts = np.concatenate([sizes[inner], line_sizes[whole]]) - WIDTH + 1
        begins = words[np.concatenate([inner, starts[whole]])]
        banded = counts >= least
        found = chain(hashes, WIDTH)
        values = bands_at(found, begins[banded], counts[banded], n_bands)
        # A line has more shingles than a sentence of it, so it has bands if the sentence has.
        at, row = np.cumsum(banded) - 1, np.zeros(len(ends), dtype=np.int64)
        row[whole] = len(inner) + np.arange(len(whole))
        sentence = np.flatnonzero(banded[: len(inner)])
        sentence = sentence[(values[at[sentence]] == values[at[row[line_of[sentence]]]]).any(axis=1)]
        near = np.zeros(len(par), dtype=bool)
        for i, j in zip(sentence, row[line_of[sentence]]):
            near[i] = similar_part(found[begins[i] :][: counts[i]], found[begins[j] :][: counts[j]])
        lengths = np.where(banded, n_bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(spans(lengths).astype(np.int32)), pa.array(signed(values.ravel())))
        owners = [batch.column(i).take(pa.array(owner)) for i in range(2)]
        columns = [*owners, pa.array(first), pa.array(span), pa.array(signed(par)), line, pa.array(near), lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "place", "span", "par", "line", "near", "bands"])

    schema = "doc_id long, text_hash long, place long, span long, par long, line long, near boolean, bands array<long>"
    return arrow_pass(_rows(docs, id_col, text_col), cut, schema)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "text"
    )


def different_paragraphs(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(par, one, line, near, band_0, ...): the different paragraphs that have bands, each with one of its occurrences."""
    places, bands = ["doc_id", "text_hash", "place", "span"], [f"band_{i}" for i in range(tune_bands())]
    banded = table.where(F.size("bands") > 0).withColumns({b: F.col("bands")[i] for i, b in enumerate(bands)})
    # All from the same row, column by column: structs and arrays would have to be sorted.
    different = banded.groupBy("par").agg(*(F.first(c).alias(c) for c in [*places, "line", "near", *bands]))
    return scratch.keep(different.select("par", F.struct(*places).alias("one"), "line", "near", *bands))


def similar_paragraphs(docs: DataFrame, table: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Edges (u, v) between the paragraphs of different_paragraphs of at least the similarity that share a band.

    Those that share a band value are compared in blocks, however many share it; a line and a sentence of it that
    share one with no other were compared where they were cut. The table is deleted.
    """
    own = scratch.keep(table.where("near").select(F.col("par").alias("u"), F.col("line").alias("v")))
    found = sharing(table, tune_bands(), scratch)
    scratch.drop(table)
    members = colliding(reduce(DataFrame.unionByName, found), scratch)
    scratch.drop(*found)
    scratch.release()
    # The shingles of those paragraphs that collide, read again from their first places, go straight to the tasks that
    # compare them: they are moved once, and no table holds them.
    # Plain equal keys that stand for a null id too: the join and the window then share one shuffle of the texts.
    key = lambda c: [F.col(c).isNotNull().alias("some"), F.coalesce(c, F.lit(0)).alias("id")]
    task = F.struct("one.place", "one.span", "par", "band", "p", "q", "first").alias("task")
    wanted = paired(members).select(*key("one.doc_id"), "one.text_hash", task)
    wanted = wanted.groupBy("some", "id", "text_hash").agg(F.collect_list("task").alias("wanted"))
    texts = _rows(docs, id_col, text_col).select(*key("doc_id"), "text_hash", "text").join(wanted, ["some", "id", "text_hash"])
    # Of rows that repeat doc_id and text one is read.
    one = F.row_number().over(Window.partitionBy("some", "id", "text_hash").orderBy("text_hash"))
    texts = texts.withColumn("one", one).where("one = 1").select("text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for text, listed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    yield from shingles_for_tasks(sentences(text), listed)

    def shingles_for_tasks(cut: list[str], listed: list[dict]) -> Iterator[pa.RecordBatch]:
        places = {w["par"]: (w["place"], w["place"] + w["span"]) for w in listed}
        found, counts = shingles(*word_hashes(["".join(cut[a:b]) for a, b in places.values()]))
        ends = spans(counts)
        sets = {par: signed(np.unique(found[a:b])).tobytes() for par, a, b in zip(places, ends, ends[1:])}
        for at in range(0, len(listed), FETCHED):
            some = listed[at : at + FETCHED]
            columns = [pa.array([w[c] for w in some], kind) for c, kind in TASK.items()]
            columns.append(pa.array([sets[w["par"]] for w in some], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*TASK, "shingles"])

    short_batches(docs.sparkSession)
    fetched = texts.mapInArrow(fetch, "band long, p int, q int, first boolean, par long, shingles binary")
    edges = tied(fetched, lambda found: np.frombuffer(found.as_buffer(), np.int64), similar)
    edges = scratch.keep(edges.unionByName(own))
    scratch.drop(members)
    scratch.release()
    return edges


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Scratch]:
    """(doc_id, text_hash, places array of (place, span)): the paragraphs that may go, before runs are looked at.

    Equal and similar paragraphs form clusters; the first occurrence, by doc_id (null last), text hash and
    place, stays and all others may go.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    whole = scratch.keep(paragraph_table(docs, id_col, text_col))
    different = different_paragraphs(whole, scratch)
    scratch.release()
    table = scratch.keep(whole.drop("line", "near", "bands"))
    scratch.drop(whole)
    edges = similar_paragraphs(docs, different, scratch, id_col, text_col)
    roots = components(edges, scratch).withColumnsRenamed({"node": "par"})
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "place", "span")
    # Most paragraphs stand alone: only those that come twice or are linked meet their occurrences.
    several = table.groupBy("par").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("par")
    linked = roots.select(F.explode(F.array("par", "root")).alias("par"))
    several = scratch.keep(several.unionByName(linked).distinct().join(roots, "par", "left"))
    found = table.join(several, "par")
    found = found.withColumn("root", F.coalesce("root", "par")).drop("par")
    found = scratch.keep(found.select("root", order.alias("at")))
    scratch.drop(table)
    scratch.release()
    stays = scratch.keep(found.groupBy("root").agg(F.min("at").alias("stays")))
    out = found.join(stays, "root").where("at != stays").select("at.doc_id", "at.text_hash", "at.place", "at.span").distinct()
    places = F.collect_list(F.struct("place", "span")).alias("places")
    return out.groupBy("doc_id", "text_hash").agg(places), scratch


def _removed(parts: list[str], places: list) -> set[int]:
    """The sentences that go: those of repeated paragraphs in runs with MIN_RUN words in all. Sentences of
    fewer words than a shingle are passed over inside a run, and go with it."""
    may = {i for p in places for i in range(p["place"], p["place"] + p["span"])}
    if not may:
        return may
    sizes = cache(lambda i: len(parts[i].encode("utf-8", "surrogatepass").split()))
    gone: set[int] = set()
    run: list[int] = []
    words = 0
    for i in sorted(may):
        between = range(run[-1] + 1, i) if run else ()
        if any(sizes(j) >= WIDTH for j in between):
            if words >= MIN_RUN:
                gone.update(run)
            run, words, between = [], 0, ()
        run += [*between, i]
        words += sizes(i)
    if words >= MIN_RUN:
        gone.update(run)
    return gone


def _with_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found, _ = repeated_paragraphs(docs, id_col, text_col)
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "places": "_places"})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct("*").alias(ROW), F.col(id_col).cast("long").alias("_own"), F.xxhash64(text).alias("_text")
    )
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    return rows.join(found, same, "left")


def paragraph_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, removed_words, kept_text) of every row of docs.

    A removed sentence is equal or similar to a sentence or line that stays elsewhere, or lies in a line that
    is (Jaccard of five-word shingles of at least 0.8, over any number of steps), and stands in a run of such
    sentences of at least MIN_RUN words.
    Null and empty texts have no paragraphs and keep an empty text. Rows that repeat doc_id and text count as
    one text, so they lose the same paragraphs and none through one another. Null doc_ids come last in order.
    An empty table gives no rows.
    """
    joined = _with_places(docs, id_col, text_col)
    rows = joined.select(F.col("_own").alias("doc_id"), F.col(ROW)[text_col].cast("string").alias("text"), "_places")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts = sentences(text or "")
            gone = _removed(parts, places or [])
            words = sum(len(parts[i].encode("utf-8", "surrogatepass").split()) for i in gone)
            out.append((len(parts), len(gone), words, "".join(p for i, p in enumerate(parts) if i not in gone)))
        names = ["doc_id", "n_sentences", "n_removed", "removed_words", "kept_text"]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out))], names)

    schema = "doc_id long, n_sentences long, n_removed long, removed_words long, kept_text string"
    return arrow_pass(rows, cut, schema)


def remove_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the repeated paragraphs; a row that has no word left goes.

    Rows that nothing was removed from stay as they are, null and empty texts too.
    """
    joined = _with_places(docs, id_col, text_col)

    @F.pandas_udf("string")
    def rest(text, places):
        out = []
        for t, p in zip(text, places):
            if t is not None and p is not None:
                parts = sentences(t)
                gone = _removed(parts, list(p))
                t = "".join(x for i, x in enumerate(parts) if i not in gone)
            out.append(t)
        return type(text)(out, dtype=object)

    kept = joined.where("_places IS NULL").select(f"{ROW}.*")
    cut = joined.where("_places IS NOT NULL").withColumn("_rest", rest(F.col(ROW)[text_col], "_places"))
    cut = cut.where(F.length(F.trim("_rest")) > 0)
    columns = [F.col("_rest").alias(c) if c == text_col else F.col(ROW)[c].alias(c) for c in docs.columns]
    return kept.unionByName(cut.select(*columns))
