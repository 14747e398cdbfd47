"""Quality rules: word statistics, and perplexity under a Spark-counted modified Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import Scratch, arrow_pass

ORDER = 4
SYMBOL_BITS = 6  # 64 symbols, so there are at most 64^4 = 16,777,216 grams, however large the corpus
SYMBOLS = 1 << SYMBOL_BITS
GRAMS = 1 << (ORDER * SYMBOL_BITS)
SLAB = 1 << 21  # symbols worked on at once

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FENCE = 3.0  # quartile distances below the lower and above the upper quartile at which the bands end
SCATTER = 600  # symbols; a band is sqrt(1 + SCATTER / n) times as wide for a text of n, as short texts scatter more

_SYMBOL_CHARS = str.maketrans("", "", "#*$%&|<>")


CAPITAL, DIGIT, SHORT_CODE, LONG_CODE = 63, 28, 61, 62  # symbols that others follow


def _ascii_spelling() -> tuple[np.ndarray, np.ndarray]:
    """First and second symbol of each ASCII code, -1 where there is no second: 0 is the text's beginning, 1 the space,
    2 to 27 the letters, 29 to 60 the other signs; capitals, digits and control codes have two."""
    first, second = np.empty(128, dtype=np.int64), np.full(128, -1, dtype=np.int64)
    signs, controls = 29, 28
    for code in range(128):
        char = chr(code)
        if char == " ":
            first[code] = 1
        elif char.isalpha():
            letter = 2 + ord(char.lower()) - ord("a")
            first[code], second[code] = (CAPITAL, letter) if char.isupper() else (letter, -1)
        elif char.isdigit():
            first[code], second[code] = DIGIT, 29 + int(char)
        elif char.isprintable():
            first[code], signs = signs, signs + 1
        else:
            first[code], second[code], controls = CAPITAL, controls, controls + 1
    return first, second


FIRST, SECOND = _ascii_spelling()


def symbols(text: str) -> np.ndarray:
    """A text as symbols, which spell each code point: no two texts have the same.

    Beyond ASCII a code point is its bits, six to a symbol: two after SHORT_CODE, three after LONG_CODE, or four after
    CAPITAL and 0.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    plain = codes < 128
    ascii_codes = np.where(plain, codes, 0)
    wide = np.where(codes < 1 << 12, 2, np.where(codes < 1 << 18, 3, 4))  # symbols for the bits
    sizes = np.where(plain, 1 + (SECOND[ascii_codes] >= 0), 1 + wide + (wide == 4))
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    out[starts] = np.where(plain, FIRST[ascii_codes], np.array([0, 0, SHORT_CODE, LONG_CODE, CAPITAL])[wide])
    two = np.flatnonzero(plain & (sizes == 2))
    out[starts[two] + 1] = SECOND[codes[two]]
    later = np.flatnonzero(~plain)
    if len(later):
        out[starts[later[wide[later] == 4]] + 1] = 0
        for i in range(4):
            of = later[wide[later] > i]
            out[starts[of] + sizes[of] - 1 - i] = codes[of] >> (i * SYMBOL_BITS) & (SYMBOLS - 1)
    return out


def gram_slabs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, row of each gram) of all texts, whole, some SLAB grams at a time. A gram ends at each symbol."""
    held, rows, size = [], [], 0
    for row, text in enumerate(texts):
        found = np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), symbols(text)])
        for at in range(0, len(found) - ORDER + 1, SLAB):
            part = found[at : at + SLAB + ORDER - 1]
            gram = part[: len(part) - ORDER + 1]
            for i in range(1, ORDER):
                gram = (gram << SYMBOL_BITS) | part[i : len(part) - ORDER + 1 + i]
            held.append(gram)
            rows.append(np.full(len(gram), row))
            size += len(gram)
            if size >= SLAB:
                yield np.concatenate(held), np.concatenate(rows)
                held, rows, size = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(rows)


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n) over all texts. Tasks add up in one array of 64^4 counts and hand on what is not zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            for grams, _ in gram_slabs([t or "" for t in batch.column(0).to_pylist()]):
                counts = np.zeros(GRAMS, dtype=np.int64) if counts is None else counts
                np.add.at(counts, grams, 1)
        if counts is not None:
            seen = np.flatnonzero(counts)
            for at in range(0, len(seen), 100_000):
                part = seen[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], ["gram", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """The model as sorted arrays. Of each order: the grams seen with their log probabilities, and the
    contexts seen with the log weight that goes to the next lower order."""

    grams: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    log_rest: list[np.ndarray]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each gram after those before it."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            gram = grams[todo] & ((1 << (order * SYMBOL_BITS)) - 1)
            at, hit = _find(self.grams[order - 1], gram)
            out[todo[hit]] += self.log_p[order - 1][at[hit]]
            todo, gram = todo[~hit], gram[~hit]
            at, hit = _find(self.contexts[order - 1], gram >> SYMBOL_BITS)
            out[todo[hit]] += self.log_rest[order - 1][at[hit]]
        out[todo] -= np.log(SYMBOLS)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts from the counts of counts; a half each where these don't give any."""
    of = [F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]
    n1, n2, n3, n4 = counts.agg(*[c.alias(f"n{i}") for i, c in enumerate(of)]).first()
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def fit(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> KneserNey:
    """Counts all texts and builds the interpolated modified Kneser-Ney model by joins over the gram tables.

    The highest order has the counts themselves, each lower one the number of different symbols that come
    before. The tables have 64^n rows at most, which bounds what comes to the driver and is broadcast.
    """
    tables = [scratch.keep(gram_counts(docs, text_col))]
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND((1 << (order * SYMBOL_BITS)) - 1)
        tables.insert(0, scratch.keep(tables[0].groupBy(suffix.alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    model, lower = KneserNey([], [], [], []), None
    for order, counts in enumerate(tables, 1):
        d = _discounts(counts)
        n = F.col("n")
        discount = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        context = F.shiftright("gram", SYMBOL_BITS).alias("context")
        contexts = counts.groupBy(context).agg(F.sum("n").alias("total"), F.sum(discount).alias("rest"))
        joined = counts.withColumn("context", context).join(contexts, "context")
        below = F.lit(1.0 / SYMBOLS)
        if lower is not None:
            suffix = F.col("gram").bitwiseAND((1 << ((order - 1) * SYMBOL_BITS)) - 1)
            joined = joined.withColumn("lower_gram", suffix).join(lower, "lower_gram")
            below = F.col("lower_p")
        p = ((n - discount) + F.col("rest") * below) / F.col("total")
        probabilities = scratch.keep(joined.select("gram", p.alias("p")))
        for table, key, value, keys, values in (
            (probabilities, "gram", F.log("p"), model.grams, model.log_p),
            (contexts, "context", F.log(F.col("rest") / F.col("total")), model.contexts, model.log_rest),
        ):
            found = table.select(key, value.alias("value")).toArrow()
            sort = np.argsort(found.column(0).to_numpy())
            keys.append(found.column(0).to_numpy()[sort])
            values.append(found.column(1).to_numpy()[sort])
        lower = probabilities.select(F.col("gram").alias("lower_gram"), F.col("p").alias("lower_p"))
    return model


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_symbols = len(text) - len(text.translate(_SYMBOL_CHARS))
    return len(words), chars, n_symbols, len(lines) - len(set(lines)), _repeat_words(words)


def _repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows that are found twice or more. Windows are told apart exactly, by doubling ranks."""
    if len(words) <= window:
        return 0
    ranks: dict[bytes, int] = {}
    rank = np.array([ranks.setdefault(w, len(ranks)) for w in words])
    if len(ranks) == len(words):
        return 0
    width = 1
    while width < window:
        pair = rank[:-width] * np.int64(len(words) + 1) + rank[width:]
        distinct, rank, times = np.unique(pair, return_inverse=True, return_counts=True)
        if len(distinct) == len(pair):
            return 0
        width *= 2
    starts = np.flatnonzero(times[rank] > 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, entropy, lang).

    Base rules fail texts below MIN_WORDS words or with over MAX_REPEAT_PERCENT percent of repeated words.
    The model is counted over all texts; a text's entropy is its mean negative log probability by symbol
    (perplexity is its exponential). Each language has its own lower and upper band, fence quartile distances
    outside the quartiles of its texts that pass the base rules, and wider for short texts, whose means scatter
    more (SCATTER); a text outside its band is not kept.

    A null text has no words and fails; a null language is a language of its own. Repeated rows are returned
    as often as they come. A language whose quartiles are equal has a band of that one value. An empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, scratch, text_col))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        stats = [pa.array(c, pa.int64()) for c in zip(*map(word_statistics, texts))]
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for grams, rows in gram_slabs(texts):
            total += np.bincount(rows, model.value.score(grams), len(texts))
            n += np.bincount(rows, minlength=len(texts))
        entropy = -total / np.maximum(n, 1)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *stats, pa.array([len(t) for t in texts], pa.int64()), pa.array(entropy)], names)

    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "length", "entropy"]
    columns = [(id_col, "long", "doc_id"), (lang_col, "string", "lang"), (text_col, "string", "text")]
    rows = docs.select(*[F.col(c).cast(t).alias(a) for c, t, a in columns])
    schema = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in names[2:8]) + ", entropy double"
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    judged = arrow_pass(rows, judge, schema).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeats)
    judged = scratch.keep(judged)
    bands = perplexity_quartiles(judged.where("NOT base_failed"))
    out = judged.join(bands, judged["lang"].eqNullSafe(bands["lang"]), "left").drop(bands["lang"])
    wider = F.sqrt(1 + SCATTER / F.greatest("length", F.lit(1)))
    margin = (F.col("q3") - F.col("q1")) * fence * wider
    inside = F.coalesce(F.col("entropy").between(F.col("q1") - margin, F.col("q3") + margin), F.lit(False))
    kept = (~F.col("base_failed")) & inside
    return out.select("doc_id", *names[2:7], "base_failed", kept.alias("kept"), "entropy", "lang")


def perplexity_quartiles(judged: DataFrame) -> DataFrame:
    """(lang, q1, q3) of the entropies of all texts of a language, combined before the shuffle."""
    quartiles = F.percentile_approx("entropy", [0.25, 0.75], 10_000).alias("q")
    return judged.groupBy("lang").agg(quartiles).select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
