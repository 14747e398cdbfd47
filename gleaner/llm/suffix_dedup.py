"""Exact substring dedup: repeated byte strings of a minimum length, by bounded backward extension.

A Burrows-Wheeler transform of a whole corpus would have to be gathered; so the suffixes are first parted
into sets that can't share a string of the minimum length with one another. Each string of LENGTH bytes has
one anchor, the least hash among its SEED_BYTES-byte pieces; equal strings have equal anchors at equal
places. The suffixes that begin at one anchor are one set. Inside a set the work goes by the transform: all
intervals of suffixes that agree are extended backwards at once, by the column of bytes before them, one byte
longer with each level. At level L two suffixes of an interval share L bytes before the anchor, and their
common prefix from the anchor on tells whether that makes LENGTH bytes; the levels stop there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch, arrow_pass, signed

LENGTH = 400
SEED_BYTES = 64
SLAB = 1 << 18  # windows worked on at once
BATCH = 8192  # suffixes extended at once
HOT = 20_000  # different suffixes of one anchor beyond which its strings are counted by Spark, one by one

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15


def _piece_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width bytes at each place; width is a power of two. Doubles the length hashed each time."""
    with np.errstate(over="ignore"):
        h, factor, w = data.astype(np.uint64) + np.uint64(1), _BASE, 1
        while w < width:
            h = h[:-w] * np.uint64(factor) + h[w:]
            factor, w = factor * factor % (1 << 64), 2 * w
        for shift, by in zip((30, 27), _MIX):
            h = (h ^ (h >> np.uint64(shift))) * by
    return h ^ (h >> np.uint64(31))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, length: int = LENGTH, width: int = SEED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchor of the string of length bytes at each place: the first least hash in it."""
    hashes = _piece_hashes(data, width)
    low = np.uint64((1 << 24) - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    place = (_sliding_min(packed, length - width + 1) & low).astype(np.int64)
    return place, hashes[place]


def _slabs(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) with some SLAB windows in all; long texts come in overlapping parts."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, SLAB):
            part = text[at : at + SLAB + length - 1]
            held.append((number, at, part))
            size += len(part)
            if size >= SLAB:
                yield held
                held, size = [], 0
    if held:
        yield held


def segments(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """Runs of strings with the same anchor: (anchor, seg, doc_id, t1, t2, at, wins, off).

    The strings begin at byte at, at + 1, ... (wins of them) of the text with hashes t1 and t2; the anchor is
    off bytes after the first one. seg tells segments of an anchor apart by their bytes. Every string of
    length bytes of every text lies in exactly one segment.
    """
    names = ["anchor", "seg", "doc_id", "t1", "t2", "at", "wins", "off"]

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]
        found: list[list[np.ndarray]] = []
        for slab in _slabs(texts, length):
            data = np.frombuffer(b"".join(part for _, _, part in slab), dtype=np.uint8)
            sizes = np.array([len(part) for _, _, part in slab])
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            place, hashes = anchors(data, length)
            # Strings that run over the end of their part belong to no text.
            owner = np.repeat(np.arange(len(slab)), sizes)[: len(place)]
            valid = np.flatnonzero(np.arange(len(place)) <= (starts + sizes - length)[owner])
            new = np.ones(len(valid), dtype=bool)
            new[1:] = (place[valid[1:]] != place[valid[:-1]]) | (np.diff(valid) != 1)
            first = np.flatnonzero(new)
            begin, wins = valid[first], np.diff(np.append(first, len(valid)))
            part = owner[begin]
            off = place[begin] - begin
            whole = data.tobytes()
            ends = begin + wins - 1 + length
            seg = [xxhash.xxh64_intdigest(whole[a:b], o) for a, b, o in zip(begin.tolist(), ends.tolist(), off.tolist())]
            number = np.array([n for n, _, _ in slab])[part]
            at = begin - starts[part] + np.array([o for _, o, _ in slab])[part]
            found.append([signed(hashes[begin]), signed(np.array(seg, dtype=np.uint64)), number, at, wins, off])
        if not found:
            return None
        anchor, seg, number, at, wins, off = (np.concatenate(c) for c in zip(*found))
        owners = [batch.column(i).take(pa.array(number)) for i in range(3)]
        numbers = [pa.array(c.astype(np.int64)) for c in (at, wins, off)]
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seg), *owners, *numbers], names)

    return arrow_pass(_rows(docs, id_col, text_col), cut, ", ".join(f"{n} long" for n in names))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashes = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", *hashes, "text")


def _right_order(right: list[bytes], group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, bytes from the anchor on), and in it the common prefix with the one before."""
    sizes = np.array([len(r) for r in right])
    padded = np.zeros((len(right), length), dtype=">u2")  # a byte is its value plus one, so that zero is the end
    for i, r in enumerate(right):
        padded[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    padded[np.arange(length)[None, :] < sizes[:, None]] += 1
    order = np.argsort(padded.reshape(len(right), -1).view(f"S{2 * length}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    same = padded[order[1:]] == padded[order[:-1]]
    common = np.where(same.all(axis=1), length, same.argmin(axis=1))
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def extend_backwards(
    group: np.ndarray, data: list[bytes], off: np.ndarray, wins: np.ndarray, length: int = LENGTH
) -> np.ndarray:
    """Which strings of each segment occur in another segment of its group: a row of length flags for each.

    Flag L is that of the string that begins L bytes before the anchor. All intervals are extended together:
    the interval of a suffix is known by a number, and the pair (number, byte before) numbers the next ones.
    An interval of one suffix is not extended any more.
    """
    order, common = _right_order([d[o:] for d, o in zip(data, off.tolist())], group, length)
    group, off, wins = group[order], off[order], wins[order]
    before = np.zeros((len(order), int(off.max(initial=0))), dtype=np.int64)
    for i, k in enumerate(order.tolist()):
        left = data[k][: off[i]]
        before[i, : len(left)] = np.frombuffer(left, dtype=np.uint8)[::-1]
    repeated = np.zeros((len(order), length), dtype=bool)
    alive, interval = np.arange(len(order)), group.copy()
    for level in range(length):
        if level:
            keep = off[alive] >= level
            alive, interval = alive[keep], interval[keep]
            if not len(alive):
                break
            interval = interval * 256 + before[alive, level - 1]
        _, interval, times = np.unique(interval, return_inverse=True, return_counts=True)
        keep = times[interval] > 1
        alive, interval = alive[keep], interval[keep]
        if not len(alive):
            break
        block = np.cumsum(common < length - level)[alive]  # suffixes that share the rest of the length
        begins = (off[alive] - wins[alive] < level) & (off[alive] >= level)
        pair = (interval * (len(order) + 1) + block)[begins]
        _, same, times = np.unique(pair, return_inverse=True, return_counts=True)
        repeated[alive[begins], level] = times[same] > 1
    out = np.zeros_like(repeated)
    out[order] = repeated
    return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of set flags in each row."""
    edges = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def repeated_in_sets(candidates: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, seg, lo, hi): runs of strings (counted from the segment's first) that other segments have too.

    candidates: (anchor, seg, off, wins, bytes) dealt and sorted by anchor. A task holds one batch of whole sets.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) >= BATCH:
                last = held[-1][0]
                done = len(held)
                while done and held[done - 1][0] == last:
                    done -= 1
                if done:
                    yield spans_of(held[:done])
                    held = held[done:]
        if held:
            yield spans_of(held)

    def spans_of(rows: list[tuple]) -> pa.RecordBatch:
        anchor, seg, off, wins = (np.array(c, dtype=np.int64) for c in list(zip(*rows))[:4])
        group = np.unique(anchor, return_inverse=True)[1]
        flags = extend_backwards(group, [r[4] for r in rows], off, wins, length)
        row, first, last = _runs(flags)
        columns = [anchor[row], seg[row], off[row] - last, off[row] - first]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "seg", "lo", "hi"])

    return candidates.mapInArrow(extend, "anchor long, seg long, lo long, hi long")


def repeated_in_hot_sets(candidates: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for anchors with very many segments: Spark counts each string by a 128-bit hash of it."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        anchor, seg, _, wins, data = (c.to_pylist() for c in batch.columns)
        found = []
        for a, s, n, d in zip(anchor, seg, wins, data):
            found += [(a, s, i, xxhash.xxh3_128_digest(d[i : i + length])) for i in range(n)]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "lo", "string"])

    strings = arrow_pass(candidates, each, "anchor long, seg long, lo long, string binary")
    twice = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("string")
    return strings.join(twice, "string", "left_semi").select("anchor", "seg", "lo", F.col("lo").alias("hi"))


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(t1, t2, spans): the byte ranges of each text that are covered by repeated strings, ends excluded."""
    rows = scratch.keep(segments(docs, id_col, text_col, length))
    # Written first, as is each aggregate that is joined below: then a join has plain rows on both sides, and
    # adaptive execution can split the partition of a hot key.
    often = scratch.keep(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    shared = scratch.keep(rows.join(often, "anchor", "left_semi"))
    scratch.drop(rows)
    # Equal segments are one from here on; a segment that comes twice is repeated as a whole.
    one = F.min(F.struct("doc_id", "t1", "at", "wins", "off")).alias("one")
    segs = scratch.keep(shared.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), one))
    sets = scratch.keep(segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    wanted = segs.join(sets, "anchor").select("anchor", "seg", "size", "one.*")
    lists = wanted.groupBy("doc_id", "t1").agg(F.collect_list(F.struct("anchor", "seg", "size", "at", "wins", "off")).alias("w"))
    lists = lists.withColumnsRenamed({"doc_id": "_id", "t1": "_t1"})
    texts = _rows(docs, id_col, text_col)
    texts = texts.join(lists, texts["doc_id"].eqNullSafe(lists["_id"]) & (texts["t1"] == lists["_t1"])).select("text", "w")

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for text, listed in zip(batch.column(0), batch.column(1)):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for w in listed.as_py():
                end = w["at"] + w["wins"] - 1 + length
                found.append((w["anchor"], w["seg"], w["off"], w["wins"], data[w["at"] : end], w["size"]))
        types = [pa.int64()] * 4 + [pa.binary(), pa.int64()]
        names = ["anchor", "seg", "off", "wins", "bytes", "size"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    schema = "anchor long, seg long, off long, wins long, bytes binary, size long"
    # A repeated row of the table gives its segments again, and they are to count once.
    candidates = scratch.keep(arrow_pass(texts, fetch, schema).dropDuplicates(["anchor", "seg"]))
    few = candidates.where(F.col("size") <= HOT).drop("size").repartition("anchor").sortWithinPartitions("anchor")
    many = candidates.where(F.col("size") > HOT).drop("size")
    apart = repeated_in_sets(few, length).unionByName(repeated_in_hot_sets(many, length))
    whole = segs.where("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("lo"), (F.col("one.wins") - 1).alias("hi"))
    runs = scratch.keep(apart.unionByName(whole))
    places = shared.join(runs, ["anchor", "seg"]).select(
        "t1", "t2", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + length).alias("b")
    )
    return scratch.keep(places.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("spans")))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_bytes: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the bytes kept if asked for.

    Every byte goes that is covered by a string of length bytes that begins anywhere else too, in the same
    text or another, judged on the input alone. Null and short texts lose nothing. A repeated row is a
    document of its own, so its text repeats. Null doc_ids are kept as they are. Empty tables give no rows.
    """
    if length < SEED_BYTES:
        raise ValueError(f"the length must be {SEED_BYTES} at least")
    scratch = Scratch(docs.sparkSession, "suffixes")
    spans = repeated_spans(docs, scratch, id_col, text_col, length)
    rows = _rows(docs, id_col, text_col).join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            data = text.as_py().encode("utf-8", "surrogatepass")
            kept, at, n = [], 0, 0
            end = -1
            for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                if a > end:
                    n += 1
                    kept.append(data[at:a])
                end = max(end, b)
                at = end
            kept = b"".join(kept) + data[at:]
            out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        columns = [batch.column(0), *map(pa.array, zip(*out))]
        return pa.RecordBatch.from_arrays(columns[:6] if with_bytes else columns[:5], names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if with_bytes else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return arrow_pass(rows, cut, schema)
