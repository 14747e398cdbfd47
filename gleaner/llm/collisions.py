"""Entries that share a MinHash band, compared in blocks however many share it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch

BLOCK = 256  # entries of one band value that are compared in a task with as many others


def colliding(banded: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, n, par, one) of the rows (par, one, band) whose band value several entries share.

    Band values with the same entries are kept once. They are told by count, sum and exclusive-or of hashes.
    """
    shared = banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("par").cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64("par")).alias("check"),
    )
    shared = scratch.keep(shared.where("n > 1").groupBy("n", "total", "check").agg(F.min("band").alias("band")))
    return scratch.keep(banded.join(shared.select("band", "n"), "band"))


def sharing(rows: DataFrame, n_bands: int, scratch: Scratch) -> list[DataFrame]:
    """For each band, (par, one, band) of the rows (par, one, line, band_0, ...) whose value several of them share.

    A row and the row whose par is its line are left out where no other shares their value: they were compared before.
    One band is looked at after the other and its shuffles are released, so that disk never holds all bands.
    """
    found = []
    for i in range(n_bands):
        banded = rows.select("par", "one", "line", F.col(f"band_{i}").alias("band"))
        home = F.coalesce("line", "par")
        several = banded.groupBy("band").agg(
            F.count(F.lit(1)).alias("n"), F.count("line").alias("parts"), F.min(home).alias("least"), F.max(home).alias("most")
        )
        several = several.where("n > 1 AND NOT (n = 2 AND parts = 1 AND least = most)")
        several = scratch.keep_small(several.select("band"))
        found.append(scratch.keep(banded.join(several, "band").select("par", "one", "band")))
        scratch.release()
    return found


def ties(first: list[tuple], second: list[tuple], alike: Callable) -> Iterator[tuple[int, int]]:
    """Edges that join what alike pairs between two lists of (par, what is compared) join.

    Breadth-first: an entry that was reached is held against those of the other list not reached yet, so a
    list of near-copies costs about one comparison each, and no pair is left out that could join more.
    """
    both = dict(first) | dict(second)
    firsts, seconds = {p for p, _ in first}, {p for p, _ in second}
    left = set(both)
    while left:
        queue = [left.pop()]
        while queue:
            a = queue.pop()
            partners = (left & seconds if a in firsts else set()) | (left & firsts if a in seconds else set())
            for b in partners:
                if alike(both[a], both[b]):
                    yield a, b
                    left.discard(b)
                    queue.append(b)


def paired(members: DataFrame) -> DataFrame:
    """(band, p, q, first, par, one): for each of colliding's entries the tasks that compare it, two blocks of about
    BLOCK entries of a band value each."""
    shares = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.select("band", "par", "one", shares.alias("shares"))
    block = F.pmod(F.xxhash64("par", F.lit(1)), F.col("shares").cast("long")).cast("int")
    dealt = dealt.withColumn("block", block)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    task = [F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")]
    return dealt.select("band", *task, (F.col("block") <= F.col("other")).alias("first"), "par", "one")


def tied(rows: DataFrame, take: Callable, alike: Callable) -> DataFrame:
    """Edges (u, v) between colliding entries that are alike.

    rows are paired's (band, p, q, first, par) with other columns, of which take makes what alike compares. Each
    task hands back at most one edge for each of its entries.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, ([], [])
        for batch in batches:
            edges = []
            keys = zip(*(c.to_pylist() for c in batch.columns[:5]))
            for (band, p, q, first, par), found in zip(keys, zip(*batch.columns[5:])):
                if (band, p, q) != key:
                    edges += ties(*lists, alike)
                    key, lists = (band, p, q), ([], [])
                entry = (par, take(*found))
                if first:
                    lists[0].append(entry)
                if p == q or not first:
                    lists[1].append(entry)
            yield edge_batch(edges)
        yield edge_batch(list(ties(*lists, alike)))

    def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        u, v = ([e[i] for e in edges] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    tasks = rows.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return tasks.mapInArrow(compare, "u long, v long")
