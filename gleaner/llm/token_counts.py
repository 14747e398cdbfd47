"""Token counts of whole texts by a two-tier lookup of pre-token lengths; no text or pre-token is shuffled for them."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import arrow_pass, id_and_text, short_batches
from gleaner.llm.tokens import tokenizer

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
FREQUENT = 32_768  # entries of the broadcast table: below 4 MB
COUNTERS = 65_536  # pre-tokens that a task's summary of its texts holds
CACHE = 400_000  # entries a worker remembers before it starts anew
SHORT = 64  # longer pre-tokens are not remembered

#: The pre-token pattern of the byte-level tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def met(name: str) -> dict[str, int]:
    """What this worker has encoded so far; it outlives the task."""
    return {}


@functools.cache
def classed_alike(name: str, sign: str) -> bool:
    """Whether the library takes the sign for a letter, number, space or other sign just as the pattern here does.

    Their Unicode tables may be of different age. Pre-tokens depend on nothing but the classes of their signs.
    """
    split, pattern = tokenizer(name).pre_tokenizer.pre_tokenize_str, regex.compile(PRE_TOKEN)
    return all(
        [len(shown) for shown, _ in split(probe)] == [len(p.encode()) for p in pattern.findall(probe)]
        for probe in (f"a{sign}1", f"!{sign}!")
    )


class PreTokenLengths:
    """Number of tokens of each pre-token: first the frequent table, then what this worker has met."""

    def __init__(self, name: str, frequent: dict[str, int]):
        self.name, self.frequent, self.met = name, frequent, met(name)
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = [t.content for t in tokenizer(name).get_added_tokens_decoder().values()]
        self.alike: set[str] = set()

    def plain(self, text: str) -> bool:
        """Not so with special strings, or with a sign that the library's Unicode tables class otherwise."""
        if any(s in text for s in self.special):
            return False
        if not text.isascii() and (new := set(text) - self.alike):
            self.alike |= {c for c in new if classed_alike(self.name, c)}
            return new <= self.alike
        return True

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.plain(text):
            return len(tokenizer(self.name).encode(text, add_special_tokens=False).ids)
        parts = self.pattern.findall(text)
        lengths = list(map(self.frequent.get, parts))
        missed = [p for p, n in zip(parts, lengths) if n is None]
        return sum(filter(None, lengths)) + self._missed(missed)

    def _missed(self, parts: list[str]) -> int:
        met = self.met
        if len(met) > CACHE:
            met.clear()
        new = list({p for p in parts if p not in met})
        if new:
            for part, found in zip(new, tokenizer(self.name).encode_batch(new, add_special_tokens=False)):
                met[part] = len(found.ids)
        total = sum([met[p] for p in parts])
        for part in new:
            if len(part) > SHORT:
                del met[part]
        return total


class FrequentItems:
    """A summary of a stream: items with their counts, too small by seen / (size + 1) at most.

    Whatever makes up more than this share of the stream is in it, whatever its order; summaries of parts of a
    stream add up. It holds up to twice its size before it subtracts.
    """

    def __init__(self, size: int):
        self.size, self.counts = size, Counter()

    def update(self, items: list[str]) -> None:
        self.counts.update(items)
        if len(self.counts) > 2 * self.size:
            self.shrink()

    def shrink(self) -> None:
        """Subtracts the count that the first item beyond the size has; items left with nothing go."""
        if len(self.counts) > self.size:
            values = np.fromiter(self.counts.values(), np.int64, len(self.counts))
            off = int(np.partition(values, len(values) - self.size - 1)[len(values) - self.size - 1])
            self.counts = Counter({item: n - off for item, n in self.counts.items() if n > off})


def frequent_lengths(docs: DataFrame, name: str = TOKENIZER, text_col: str = "text") -> dict[str, int]:
    """Lengths of the FREQUENT commonest pre-tokens of all texts.

    Each task hands back a summary of COUNTERS pre-tokens of the texts it reads, and only these are grouped.
    The table only saves work: a pre-token that is not in it is encoded where it is met, so no result
    depends on it.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    pattern = regex.compile(PRE_TOKEN)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = FrequentItems(COUNTERS)
        for batch in batches:
            for text in batch.column(0):
                found.update([p for p in pattern.findall(text.as_py()) if len(p) <= SHORT])
        found.shrink()
        columns = [pa.array(list(found.counts), pa.string()), pa.array(list(found.counts.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n"])

    counts = texts.mapInArrow(summary, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "part").limit(FREQUENT).collect()
    parts = [r["part"] for r in rows]
    encoded = tokenizer(name).encode_batch(parts, add_special_tokens=False) if parts else []
    return {p: len(e.ids) for p, e in zip(parts, encoded)}


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, limit: int = LIMIT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Counts equal the library's on the whole text, special strings included. A null text has no bytes and no
    tokens; null doc_ids and repeated rows are returned as they come, very long texts are counted whole. The
    input is read once for the frequent pre-tokens and once for the counts, and no row is shuffled for the counts.
    """
    short_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name, text_col))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = PreTokenLengths(name, table.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        n_tokens = [lengths.count(t) for t in texts]
        over = [n > limit for n in n_tokens]
        columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return arrow_pass(id_and_text(docs, id_col, text_col), count, schema)
