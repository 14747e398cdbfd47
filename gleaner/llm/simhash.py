"""SimHash near-duplicates: whole-text fingerprints, tiled exact comparison, groups."""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleaner.llm.common import ROW, Scratch, arrow_pass, id_and_text, signed
from gleaner.llm.components import components

SEED = 42
LANES = 4  # a fingerprint is tiled by the bit counts of so many equal parts of it
TILE = 1024  # fingerprints in a tile: 8 KB
_BLOCK = 255  # rows whose bits can be added up in one byte


def _bit_majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK * 1024):
        part = hashes[at : at + _BLOCK * 1024]
        padded = np.zeros(-(-len(part) // _BLOCK) * _BLOCK, dtype=">u8")
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8)).reshape(-1, _BLOCK, 64)
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash over all shingles of width words, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]
    return _bit_majority(np.array(hashes, dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row; null and blank texts have fingerprint 0."""

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(2)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signed(fps))], ["doc_id", "text_hash", "fp"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_pass(rows, digest, "doc_id long, text_hash long, fp long")


def _cell(fp: Column) -> Column:
    """The bit counts of the parts, five bits each and raised by 4 so that a shift by up to 4 can't borrow."""
    bits, cell = 64 // LANES, F.lit(0)
    for i in range(LANES):
        part = F.shiftrightunsigned(fp, i * bits).bitwiseAND((1 << bits) - 1)
        cell = cell + F.shiftleft(F.bit_count(part) + 4, 5 * i)
    return cell


def _shifts(radius: int) -> list[int]:
    """All ways in which the bit counts of two fingerprints within the radius can differ, as steps of the cell."""
    steps = product(range(-radius, radius + 1), repeat=LANES)
    return [sum(x << (5 * i) for i, x in enumerate(s)) for s in steps if sum(map(abs, s)) <= radius]


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the close pairs between two tiles join, at most one for each fingerprint.

    All pairs are compared. A fingerprint of b is tied to the first of a that it is close to; those of a that
    are tied to one of b together, but to different ones first, are tied through that one.
    """
    close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    i, j = np.nonzero(close)
    label = np.arange(len(a))  # the smallest place in a that each place is known to be joined to
    while len(i):
        least = np.full(len(b), len(a))
        np.minimum.at(least, j, label[i])
        lower = label.copy()
        np.minimum.at(lower, i, least[j])
        if (lower == label).all():
            break
        label = lower
    least = np.full(len(b), len(a))
    np.minimum.at(least, j, label[i])
    hit, moved = least < len(a), label != np.arange(len(a))
    return np.concatenate([b[hit], a[moved]]), np.concatenate([a[least[hit]], a[label[moved]]])


def close_edges(distinct: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints (column fp) within the radius, over any number of steps.

    Tiles hold fingerprints with equal bit counts in each of LANES parts, at most about TILE of them. Two
    tiles meet in a task only if their counts differ by no more than the radius in sum, because every
    differing bit moves one count by one. There all their pairs are compared by exclusive-or and bit count;
    what comes back are at most as many edges as fingerprints. The table of tile counts that is broadcast has
    17^4 = 83,521 rows at most, whatever the input.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the radius must be 0 to 4")
    lanes = distinct.select("fp", _cell(F.col("fp")).alias("cell"))
    sizes = lanes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("long").alias("tiles"))
    sizes = scratch.keep(sizes)
    placed = lanes.join(F.broadcast(sizes), "cell")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    tiles = scratch.keep(placed.groupBy("cell", tile.alias("tile")).agg(F.collect_list("fp").alias("fps")))

    others = sizes.select(F.col("cell").alias("other"), F.col("tiles").alias("others"))
    near = F.transform(F.array(*map(F.lit, _shifts(radius))), lambda s: F.col("cell") + s)
    meets = tiles.withColumn("other", F.explode(near)).join(F.broadcast(others), "other")
    meets = meets.withColumn("other_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    here = F.shiftleft(F.col("cell").cast("long"), 40) + F.col("tile")
    there = F.shiftleft(F.col("other").cast("long"), 40) + F.col("other_tile")
    left = meets.where(here <= there).select(here.alias("p"), there.alias("q"), F.col("fps").alias("a"))
    right = meets.where(here >= there).select(there.alias("p"), here.alias("q"), F.col("fps").alias("b"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        us, vs = [], []
        for a, b in zip(batch.column(0), batch.column(1)):
            u, v = _forest(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), radius)
            us.append(u[u != v])
            vs.append(v[u != v])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(signed(v))], ["u", "v"])

    return arrow_pass(left.join(right, ["p", "q"]).select("a", "b"), compare, "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component_id, group, text_hash) for every document.

    Documents are linked when their fingerprints differ in at most radius bits; component_id is the smallest
    doc_id reachable, and group names the component also where ids are null or repeated. Texts without words
    have fingerprint zero and are linked like any other. A row without
    doc_id keeps a null id and takes part; a component of such rows alone has a null component_id. Repeated
    rows are returned as often as they come. An empty table gives an empty result.

    Copies share a fingerprint and are grouped by it, so that however many there are only one value goes
    into the comparison. A hot fingerprint meets its single group row in the last join, which adaptive
    execution splits.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, id_col, text_col, width))
    groups = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = scratch.keep(close_edges(groups.select("fp"), scratch, radius))
    roots = components(edges, scratch)
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left")
    rooted = scratch.keep(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    named = rooted.join(ids, "root").select("fp", "component_id", digits("root").alias("group"))
    return fps.join(named, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", "group", "text_hash")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3
) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of simhash_groups: the one with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest text hash stays, and of repeated rows one. Rows
    without doc_id come last; a group of such rows alone keeps one. Texts without words are one group. A null
    in another column is kept as it is; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "copies")
    groups = simhash_groups(docs, id_col, text_col, radius, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    stands = scratch.keep(groups.groupBy("group").agg(first)).select("one.doc_id", "one.text_hash").distinct()
    # Plain equal keys that stand for a null id too: the join and the window share one shuffle of the rows.
    key = lambda c: [F.col(c).isNotNull().alias("_some"), F.coalesce(c, F.lit(0)).alias("_id")]
    stands = stands.select(*key("doc_id"), F.col("text_hash").alias("_hash"))
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias(ROW), F.col(id_col).cast("long").alias("_own"), text_hash.alias("_hash"))
    rows = rows.select(ROW, *key("_own"), "_hash")
    kept = rows.join(stands, ["_some", "_id", "_hash"], "left_semi")
    place = F.row_number().over(Window.partitionBy("_some", "_id", "_hash").orderBy(F.lit(0)))
    return kept.withColumn("_n", place).where("_n = 1").select(f"{ROW}.*")
