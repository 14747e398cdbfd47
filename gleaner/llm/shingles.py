"""Word shingles of many texts at once: hashes, identities, MinHash signatures and bands."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gleaner.llm.common import spans, within

WIDTH = 5  # words in a shingle
SIMILARITY = 0.8
RECALL = 0.99  # of pairs just at the similarity
ROWS = 2  # hashes in a band
SEED = 42


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that finds pairs at the similarity with the recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def word_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each part); words are lower-cased in A-Z."""
    data = pa.array([p.encode("utf-8", "surrogatepass") for p in parts], pa.binary()).view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(data))
    words = split.flatten()
    some = pc.not_equal(pc.binary_length(words), 0)  # white space at either end leaves an empty word there
    before = spans(some.to_numpy(zero_copy_only=False))
    different = words.filter(some).dictionary_encode()
    plain = different.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in plain), np.uint64, len(plain))
    return hashes[different.indices.to_numpy()], np.diff(before[split.offsets.to_numpy()])


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the width words at each place, in order."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for i in range(width):
            out = mix(out + np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(out)])
    return out


def shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, how many of each paragraph); a paragraph of fewer words than WIDTH has none."""
    counts = np.maximum(sizes - WIDTH + 1, 0)
    starts = np.repeat(spans(sizes)[:-1], counts) + within(counts)
    return (chain(hashes, WIDTH)[starts] if len(starts) else np.zeros(0, np.uint64)), counts


def identities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash of each paragraph's whole words, in order."""
    with np.errstate(over="ignore"):
        placed = mix(hashes + mix(within(sizes).astype(np.uint64)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(placed, dtype=np.uint64)])
        ends = spans(sizes)
        return mix(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64))


def signatures(found: np.ndarray, starts: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures, a row for each paragraph of counts shingles from starts on; counts are all positive."""
    ends = np.stack([starts, starts + counts], axis=1).ravel()  # every second run lies between two paragraphs
    last = np.array([np.iinfo(np.uint64).max], dtype=np.uint64)  # so that an end may be the end of all
    keys = mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([np.minimum.reduceat(np.concatenate([mix(found ^ k), last]), ends)[::2] for k in keys], axis=1)


def bands_at(found: np.ndarray, starts: np.ndarray, counts: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """One hash of each MinHash band, a row for each paragraph; paragraphs may overlap, counts are all positive."""
    if not len(counts):
        return np.zeros((0, n_bands), dtype=np.uint64)
    values = signatures(found, starts, counts, n_bands * rows).reshape(-1, n_bands, rows)
    with np.errstate(over="ignore"):
        out = np.ones(values.shape[:2], dtype=np.uint64) * np.arange(1, n_bands + 1, dtype=np.uint64)
        for i in range(rows):
            out = mix(out * np.uint64(31) + values[:, :, i])
    return out


def bands(found: np.ndarray, counts: np.ndarray, n_bands: int, rows: int = ROWS) -> np.ndarray:
    """bands_at of paragraphs whose shingles follow one another."""
    return bands_at(found, spans(counts)[:-1], counts, n_bands, rows)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= least * large and jaccard(a, b) >= least


def similar_part(part: np.ndarray, whole: np.ndarray, least: float = SIMILARITY) -> bool:
    """similar of the shingles, repeats included, of a part of a paragraph and of the whole, which has all of them."""
    large = len(set(whole.tolist()))
    if len(part) < least * large:
        return False
    small = len(set(part.tolist()))
    return small >= least * large and small / large >= least
